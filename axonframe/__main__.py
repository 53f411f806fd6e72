"""python -m axonframe sort TRACES FOLDER --fs 18518: sorts the channels of a Parquet table (channel, ix, v) into a run folder."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from axonframe.config import Settings
from axonframe.sources.recordings import first_files
from axonframe.sources.runs import RunFolder, sort_into


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="axonframe", description=__doc__)
    parts = parser.add_subparsers(dest="what", required=True)
    sort = parts.add_parser("sort", help="sort the channels that are not done")
    sort.add_argument("traces")
    sort.add_argument("folder")
    sort.add_argument("--fs", type=float, required=True, help="samples a second")
    sort.add_argument("--settings", help="INI or JSON file")
    sort.add_argument("--some-files", action="store_true", help="only as many files as the settings give for today")
    sort.add_argument("--filtered", action="store_true", help="the traces are filtered already")
    sort.add_argument("--least-seconds", type=int, default=60)
    status = parts.add_parser("status", help="latest states and runs")
    status.add_argument("folder")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("axonframe").getOrCreate()
    folder = RunFolder(spark, given.folder)
    if given.what == "status":
        folder.status().orderBy("channel", "stage").show(10_000, False)
        folder.info().orderBy("started").show(1000, False)
        return
    settings = Settings()
    if given.settings:
        with open(given.settings) as f:
            settings = Settings.from_json(f.read()) if given.settings.endswith(".json") else Settings.read(given.settings)
    traces = first_files(spark, given.traces, settings.files_for(dt.date.today())) if given.some_files else [given.traces]
    run = dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S")
    sort_into(folder, spark.read.parquet(*traces), settings, given.fs, run, filtered=given.filtered, least_seconds=given.least_seconds).orderBy("channel").show(10_000, False)


if __name__ == "__main__":
    main()

"""python -m lexiforge INPUT [--sheet S] [--keyword-column C] [--output DIR] [--volume] [--no-duplicates]"""

import argparse

from pyspark.sql import SparkSession

from lexiforge import runtime
from lexiforge.plans.pipeline import PipelineConfig, run


def main() -> None:
    p = argparse.ArgumentParser(prog="lexiforge")
    p.add_argument("input")
    p.add_argument("--sheet")
    p.add_argument("--keyword-column")
    p.add_argument("--output", default="output")
    p.add_argument("--volume", action="store_true")
    p.add_argument("--no-duplicates", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("lexiforge").getOrCreate()
    runtime.ship(spark)
    config = PipelineConfig(duplicates=not a.no_duplicates, volume=a.volume)
    result = run(spark, a.input, config=config, sheet=a.sheet, keyword_column=a.keyword_column, output=a.output)
    for k, v in result.summary.items():
        print(f"{k:12} {v}")
    print("written:", *result.files)


if __name__ == "__main__":
    main()

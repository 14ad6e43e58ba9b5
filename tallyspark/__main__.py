"""python -m tallyspark parse LOG DOCUMENT | generate URIS ROWS FOLDER [SEED]: URIS is a text file with a URI a line."""

import sys

from pyspark.sql import SparkSession

from . import jobs


def main(args: list[str]) -> int:
    if not (args[:1] == ["parse"] and len(args) == 3 or args[:1] == ["generate"] and len(args) in (4, 5)):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "parse":
        print(f"{jobs.parse(spark, *args[1:])} paths")
    else:
        jobs.generate_log(spark, spark.read.text(args[1]), args[2], args[3], *map(int, args[4:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

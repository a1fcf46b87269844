"""python -m millrace: run a registered query, or work on a store.

millrace query NAME SF_DIR OUT       write a registered query's rows as Parquet
millrace search STORE TEXT...        search a store, a line of JSON per hit
millrace verify STORE                totals of a store
millrace health STORE                what waits for vectors
millrace ingest STORE BATCH VERSION  ingest source rows from Parquet
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from .engine import Engine
from .plans import catalogue
from .session import session


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = session()
    now = F.current_timestamp()
    command, rest = args[0], args[1:]
    if command == "query":
        catalogue.QUERIES[rest[0]](spark, rest[1]).write.mode("errorifexists").parquet(rest[2])
    elif command == "search":
        asked = spark.createDataFrame([(i, q) for i, q in enumerate(rest[1:])], "query_id long, query string")
        for line in Engine(spark, rest[0]).search(asked, now).orderBy("query_id", "final_rank").toJSON().collect():
            print(line)
    elif command == "verify":
        Engine(spark, rest[0]).verify().show()
    elif command == "health":
        Engine(spark, rest[0]).health().show()
    elif command == "ingest":
        Engine(spark, rest[0]).ingest(spark.read.parquet(rest[1]), int(rest[2]), now)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

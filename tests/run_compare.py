"""python tests/run_compare.py [sf_dir] [name prefix ...]: compares every query that has SQL."""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")
from compare import compare, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as e  # noqa: E402

sf, only = sys.argv[1], sys.argv[2:]
con, q, o = duck(sf), e.queries(), e.oracle_sql()
good = 0
for name in q:
    if only and not name.startswith(tuple(only)):
        continue
    if name not in o:
        if only:
            t0 = time.time()
            try:
                print("rows", name, len(q[name](spark, sf).collect()), f"{time.time() - t0:.1f}")
            except Exception as x:
                print("BAD", name, str(x)[:600])
        continue
    t0 = time.time()
    try:
        said = compare(spark, con, q[name], o[name], sf)
    except Exception as x:
        said = f"{type(x).__name__}: {str(x)[:600]}"
    good += not said
    if said:
        print("BAD", name, said[:900], flush=True)
print("good", good, "missing", sorted(set(o) - set(q)))

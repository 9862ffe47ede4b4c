"""The stream of symbol windows: state, late rows, and the same result as over a table."""

import datetime as dt
from collections import Counter

from cladeworks.streaming import symbol_windows as sw


def test_late_rows(spark, tmp_path):
    schema = "loaded_at timestamp_ntz, residues string"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [[(day(0), "AC-g"), (None, "A"), (day(1), None)], [(day(400), "TT")], [(day(401), "T")], [(day(2), "AAAA"), (day(300), "G")]]
    for i, rows in enumerate(parts):  # a file a batch, in order of time
        out = tmp_path / "s.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(out))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(out))
    def letters(found):
        n = Counter()
        for r in found.collect():
            n[r.symbol] += r.letters
        return dict(n)

    got = letters(sw.run_to_end(spark, sw.symbol_windows(stream, late="180 days")))
    assert letters(sw.symbol_windows(spark.read.parquet(str(out)))) == {"A": 5, "C": 1, "G": 2, "T": 3}
    assert got == {"A": 1, "C": 1, "G": 2, "T": 3}  # one late row came after its window was closed, one before

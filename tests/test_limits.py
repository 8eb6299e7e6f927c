"""The time limits that hold for a table of 10,100 rows, after one warm-up."""

import time

from tablelens.operators import profile
from tablelens.plans import cleaning_run
from tablelens.session import scratch_path
from tablelens.sources import versions


def test_read_profile_and_clean_in_time(spark, tmp_path):
    path = tmp_path / "large.csv"
    lines = ["id,name,score,age"] + [f"{i},User{i},{80 + i % 21},{20 + i % 29}" for i in range(10_100)]
    path.write_text("\n".join(lines) + "\n")
    steps = [{"type": "drop_duplicates"}, {"type": "fill_missing", "column": "score", "strategy": "mean"}]

    def read():
        df = versions.import_csv(spark, str(path), scratch_path(spark, "limits"), "large")
        return df, df.count()

    def measure(df):
        return profile.column_profile(df).collect(), profile.quality_score(df).collect()

    for limits in ((None,) * 3, (5.0, 10.0, 10.0)):
        took = []
        for job in (read, lambda: measure(df), lambda: measure(cleaning_run.clean(df, steps)[0])):
            start = time.perf_counter()
            result = job()
            took.append(time.perf_counter() - start)
            if job is read:
                df, rows = result
        assert rows == 10_100
        assert all(limit is None or t < limit for t, limit in zip(took, limits)), took
    print("seconds to read, profile, clean:", [round(t, 2) for t in took])

"""Connected suppliers over all lines against brute force."""

import random

from orrery import plans


def test_all_links(spark, tmp_path):
    rng = random.Random(3)
    lines = [(p, rng.randrange(10 * (p % 4), 10 * (p % 4) + 10)) for p in range(24) for _ in range(2)]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    group = {s: s for _, s in lines}
    changed = True
    while changed:
        changed = False
        for p, s in lines:
            for q, t in lines:
                if p == q and group[t] < group[s]:
                    group[s], changed = group[t], True
    linked = {s for p, s in lines if any(q == p and t != s for q, t in lines)}
    got = {r.lane: r.group for r in plans.QUERIES["lane_groups_all"](spark, str(tmp_path)).collect()}
    assert got == {s: group[s] for s in linked} and len(set(got.values())) > 1

"""Keys of parts: near sets always meet, a gram that all texts share costs nothing."""

import numpy as np
from pyspark.sql import functions as F

from siftline.functions import grams
from siftline.operators import decontam


def test_near_sets_share_a_key():
    r = np.random.default_rng(5)
    for threshold in (0.8, 0.92):
        for a in [*range(1, 60), 140, 155, 156, 160, 194, 195, 300, 2000]:
            for b in {a, min(a + 1, int(a / threshold)), int(a / threshold + 1e-9)}:
                shared = min(a, int(np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)))
                g = r.integers(0, 1 << 63, a + b - shared).astype(np.uint64)
                x, y = np.sort(g[:a]), np.sort(g[a - shared :])
                own, key, note = grams.part_keys([x, y], threshold)
                assert set(key[(own == 0)]) & set(key[(own == 1)])
                sketch = {i: note.view(np.uint64)[own == i][0] >> np.uint64(16) for i in (0, 1)}
                assert int(sketch[0] ^ sketch[1]).bit_count() <= a + b - 2 * shared


def test_a_common_gram_is_no_key(spark):
    """Texts with a common start differ elsewhere: no pair is a candidate, whatever gram they share."""
    r = np.random.default_rng(7)
    rows = [(i, "the same words at the start of all " + "".join(map(chr, r.integers(97, 123, 150)))) for i in range(400)]
    rows += [(1000 + i, t + "!") for i, t in rows[:50]]
    df = spark.createDataFrame(rows, "num long, form string")
    met = grams.part_pairs(grams.part_rows(df, "num", "form", 3, 0.92), "num", 0.92).collect()
    assert sorted((x.x, x.y) for x in met) == [(i, 1000 + i) for i in range(50)]
    got = decontam.near_pairs(df, "num", F.col("form"), 3, 0.92)
    assert sorted((x.a, x.b) for x in got.collect()) == [(i, 1000 + i) for i in range(50)]

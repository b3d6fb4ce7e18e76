"""SimHash against a fingerprint bit by bit and all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import types as T

from paperloom.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def plain_fingerprint(text, k=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(fps):
    """Smallest id reachable from each (id, fp) at three bits or fewer."""
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x][1] ^ fps[y][1]).bit_count() <= 3 or fps[x][0] == fps[y][0]:
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    least = {}
    for x, (i, _) in enumerate(fps):
        least[find(x)] = min(least.get(find(x), i), i)
    return [least[find(x)] for x in range(len(fps))]


def test_fingerprint_bit_by_bit():
    rng = random.Random(1)
    texts = ["", "one", "one two", "A b\x0bC\td", "é漢 x y z É", "w " * 700] + [" ".join(rng.choice("ab cd e fg é".split()) for _ in range(rng.randrange(600))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t.encode().lower().split()) == plain_fingerprint(t)


def test_whole_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one", "One", "two words"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 300))]
        for _ in range(rng.randrange(1, 8)):
            now = list(base)
            for _ in range(rng.randrange(3)):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            texts.append(" ".join(now))
    data = [(1000 - i, t, None) for i, t in enumerate(texts)] + [(995, texts[-1], None), (None, "no id", None), (1000, None, None)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_simhash_dedup(spark, str(tmp_path)).collect()), key=str)
    known = [(i, plain_fingerprint(t)) for i, t, _ in data if i is not None]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(known, plain(known))] + [(None, f"{plain_fingerprint('no id'):016x}", None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("group", [2, 5, 512])
def test_links_equal_all_pairs(spark, group, monkeypatch):
    """Chains, balls and strangers, with variants opened from two, five and 512 members on."""
    rng = random.Random(group)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres) | {0, 1, (1 << 64) - 1}
    for c in centres:
        for _ in range(rng.randrange(60)):
            x = rng.choice([c, rng.choice(list(fps))])
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
        fps |= {c ^ (7 << rng.randrange(61)), c ^ (1 << rng.randrange(21)) ^ (1 << rng.randrange(21, 42)) ^ (1 << rng.randrange(42, 64))}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "GROUP", group)
    from paperloom.llm.components import components
    from paperloom.llm.store import Scratch

    # the tests' workers are forked: a bound that is set here must travel in the closure
    def bounded(batches, limit=group):
        simhash.GROUP = limit
        yield from real(batches)

    real = simhash._groups
    monkeypatch.setattr(simhash, "_groups", bounded)
    with Scratch(spark) as own:
        rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long").repartition(3)
        got = dict(map(tuple, components(spark, simhash.links(own, rows)).collect()))
    want = plain([(i, x) for i, x in enumerate(fps)])
    groups = {}
    for x, c in zip(fps, want):
        groups.setdefault(c, set()).add(simhash._signed(x))
    found = {}
    for x in fps:
        s = simhash._signed(x)
        found.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_empty_table_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(c, T.StringType() if c == "text" else T.LongType()) for c in ("doc_id", "text", "fp", "key", "way", "a `b", "many")])
    assert simhash.near_duplicates(spark, spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(5, "a b c d", 1, 2, 3, 4, 5), (3, "a b c d", 1, 2, 3, 4, 5), (4, "x y z", 1, 2, 3, 4, 5)], schema)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, rows).collect()} == {5: 3, 3: 3, 4: 4}

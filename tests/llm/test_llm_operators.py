"""The operators against brute force on small tables, and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapweave.llm import chat_format, components, decontamination, edits, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, packing, sharding, url_filter
from snapweave.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(9001, None), (9002, ""), (9003, "  \n\t "), (9004, "one"), (9004, "one"), (9005, "one"), (None, "null id text of some words here"), (9006, "é" * 5000), (9007, "w " * 30000)]


def make_docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if extra:
        for name in ("row_key", "node", "gone", "lines_removed", "component", "size"):
            df = df.withColumn(name, F.lit("x"))
    return df


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n)]


def near_texts(seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([5, 8, 40, 200]))
        for _ in range(rng.choice([1, 4, 9])):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["changed", "other", own[0]])
            rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows) + k, rows[0][1].upper()) for k in range(5)]


def shingle_sets(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        yield i, ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = list(shingle_sets(rows))
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_equals_brute_force(spark, percent):
    rows = near_texts()
    got = minhash_dedup.near_duplicates(make_docs(spark, rows), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_large_mixed_bucket(spark):
    """Many variants around the threshold: components must be whole although few pairs are verified."""
    rng = random.Random(5)
    base, rows = words(rng, 120), []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    got = minhash_dedup.near_duplicates(make_docs(spark, rows), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 85)


def test_minhash_odd_rows(spark):
    got = minhash_dedup.near_duplicates(make_docs(spark, ODD, True)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[9001].n_shingles == by[9002].n_shingles == by[9003].n_shingles == 0 and by[9001].kept
    assert by[9005].component_id == 9004 and not by[9005].kept
    assert minhash_dedup.near_duplicates(make_docs(spark, [])).count() == 0
    out = minhash_dedup.one_of_each_group(make_docs(spark, ODD, True))
    assert out.columns == make_docs(spark, [], True).columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [9001, 9002, 9003, 9004, 9006, 9007]


def test_super_minhash_estimates(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    s = minhash_dedup.super_minhash([a, b, a[:1]])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7), (3, 2), (2, 3)] + [(1000, 1000 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_resharding(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randrange(0, 300)) for k in range(900)]
    df = make_docs(spark, rows + ODD, True)
    got = sharding.reshard(df, F.when(F.col("doc_id") < 500, 0).otherwise(F.coalesce(F.col("doc_id"), F.lit(0)) % 5), 5, 7).collect()
    assert len(got) == len(rows) + len(ODD)
    by, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        by[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    mean = sum(sizes.values()) / 7
    assert max(abs(s - mean) for s in sizes.values()) <= 60001  # a row at each end of a run
    text = {i: t or "" for i, t in rows + ODD}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert sharding.reshard(make_docs(spark, []), F.lit(0), 3, 4).count() == 0


def test_resharding_in_many_blocks(spark, monkeypatch):
    """Blocks of few rows, in runs of few blocks: slots without gaps, shards of equal bytes, and no row in two."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 5)
    monkeypatch.setattr(sharding, "RUN", 3)
    rng = random.Random(14)
    rows = [(k, "x" * rng.randrange(0, 90)) for k in range(700)]
    got = sharding.reshard(make_docs(spark, rows), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 4), 4, 6).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    for n in range(6):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))
    sizes = [sum(r.size for r in got if r.shard == n) for n in range(6)]
    assert max(sizes) - min(sizes) <= 2 * 90


def test_sum_before(spark):
    rows = [(k % 2, k, k * k) for k in range(0, 9000, 7)]
    got = {r.o: r.s for r in sharding.sum_before(spark.createDataFrame(rows, "k long, o long, v long"), ["k"], "o", "v", "s").collect()}
    assert got == {o: sum(v for x, p, v in rows if x == k and p < o) for k, o, _ in rows}


def test_min_cost_transfers_are_least():
    rng = random.Random(6)
    for _ in range(30):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        ends = np.floor(np.cumsum(np.ones(m)) / m * sum(supply)).astype(int)
        capacity = np.diff(ends, prepend=0).tolist()
        capacity[-1] += sum(supply) - sum(capacity)
        plan = sharding.min_cost_transfers(supply, capacity)
        assert [sum(v for (i, _), v in plan.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in plan.items() if j == k) <= capacity[k] for k in range(m))
        stays = sum(v for (i, j), v in plan.items() if i == j)
        assert stays == sum(min(supply[k], capacity[k]) for k in range(min(n, m)))


def test_rewrite_shards(spark, tmp_path):
    docs = make_docs(spark, [(k, "t" * k) for k in range(40)])
    placed = sharding.reshard(docs, F.col("doc_id") % 2, 2, 4)
    touched = {r.shard for r in sharding.rewrite_shards(spark, docs, placed, str(tmp_path / "shards")).collect()}
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.shard for r in back.select("shard").distinct().collect()} <= touched
    assert back.count() == placed.where(F.col("shard").isin(*touched)).count()


def normal_lines(rows, min_words=5):
    """((id, line number), normalised line) of all lines that can be repeats."""
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            if len(w) >= min_words:
                yield (i, k), " ".join(w)


def brute_line_groups(rows, similarity=0.8):
    """The first line of each line's group, by edit similarity over all pairs."""
    found = list(normal_lines(rows))
    up = {at: at for at, _ in found}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (p, a) in enumerate(found):
        for q, b in found[:n]:
            if top(p) != top(q) and line_dedup.edit_within(a, b, int(round(max(len(a), len(b)) * (1 - similarity), 6))):
                x, y = top(p), top(q)
                up[max(x, y)] = min(x, y)
    return {at: top(at) for at in up}


def test_line_dedup(spark):
    rng = random.Random(8)
    lines = [" ".join(words(rng, 60)) for _ in range(6)]
    edited = [line.replace(line.split()[30], "zz", 1) for line in lines]
    rows = [(k, "\n".join([f"short {k}", lines[k % 6], rng.choice(edited) if k % 2 else lines[(k + 1) % 6].upper() + "!"])) for k in range(20)]
    docs = make_docs(spark, rows + ODD, True)
    got = line_dedup.dedup_lines(docs)
    assert got.columns[:-1] == docs.columns
    text = {r.doc_id: r.text for r in got.collect()}
    kept = [(d, line) for d in sorted(x for x in text if x is not None and x < 100) for line in text[d].split("\n") if len(line.split()) > 5]
    normal = [re.sub(r"[^0-9a-z]+", " ", line.lower()).strip() for _, line in kept]
    assert len(set(normal)) == len(normal)  # no exact repeat stays
    assert {re.sub(r"[^0-9a-z]+", " ", x.lower()).strip() for x in lines} & set(normal)  # a first one does
    assert all(f"short {k}" in text[k] for k in range(20))
    assert text[0].split("\n")[1] == lines[0]
    assert text[9001] is None and text[9002] == ""
    assert line_dedup.dedup_lines(make_docs(spark, [])).count() == 0


def test_line_dedup_against_all_pairs(spark):
    """Groups of variants around the threshold, chains and unlike lines: recall of what edit similarity alone removes, and nothing else goes."""
    rng = random.Random(9)
    rows = []
    for _ in range(25):
        base = words(rng, rng.randrange(5, 61))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 7))):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = words(rng, 1)[0]
                elif len(w) > 5:
                    del w[at]
            rows.append((len(rows), " ".join(w)))
    want = {i for (i, _), first in brute_line_groups(rows).items() if first[0] != i}
    got = {r.doc_id for r in line_dedup.dedup_lines(make_docs(spark, rows)).where("lines_removed > 0").collect()}
    assert len(want) > 30 and got <= want and len(got) >= 0.95 * len(want)


def test_line_dedup_large_group_of_variants(spark, monkeypatch):
    """One key with many lines, compared with its first one and then in cells: equal to all pairs."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(10)
    start, rows = words(rng, 30), []
    for k in range(90):  # a drift: neighbours are alike, ends are not
        start[rng.randrange(30)] = f"new{k}"
        rows.append((k, " ".join(start)))
    rows += [(200 + k, " ".join(words(rng, 30))) for k in range(20)]
    want = {i for (i, _), first in brute_line_groups(rows).items() if first[0] != i}
    got = {r.doc_id for r in line_dedup.dedup_lines(make_docs(spark, rows)).where("lines_removed > 0").collect()}
    assert got == want and len(want) == 89


def test_meet_gives_all_pairs_or_stars():
    """Keys over several batches: all near pairs of small keys; of large ones each member, and its pair with the first."""
    import pyarrow as pa

    sizes = [1, 3, 40, 2, 25]
    key = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
    node = np.arange(len(key)).astype(np.int64) + 100
    for step in (1, 4, 7, 100):
        table = pa.table({"key": key, "node": node, "s1": np.zeros(len(key), np.int64), "s2": np.zeros(len(key), np.int64)})
        got = [tuple(r.values()) for b in line_dedup._meet(iter(table.to_batches(max_chunksize=step))) for r in b.to_pylist()]
        members = {(k, a) for k, a, b in got if b is None}
        pairs = {(a, b) for _, a, b in got if b is not None}
        assert members == {(int(k), int(n)) for k, n in zip(key, node) if sizes[k] > line_dedup.SMALL}
        first = {k: int(node[key == k][0]) for k in range(len(sizes))}
        assert pairs == {(int(a), int(b)) for x, a in zip(key, node) for y, b in zip(key, node) if x == y and a < b and (sizes[x] <= line_dedup.SMALL or a == first[x])}


def test_edit_within():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(14))) for _ in "ab")
        for most in (0, 2, 5):
            assert line_dedup.edit_within(a, b, most) == (distance(a, b) <= most)
    near = 0
    for k in range(1500):  # long lines with words swapped, replaced, dropped or repeated, and letters edited
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(12, 26))]
        other = list(words)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(other) - 1)
            kind = rng.randrange(4 if k % 2 else 1)
            other[at : at + 2] = [[other[at + 1], other[at]], ["zq", other[at + 1]], [other[at]], [other[at], other[at][::-1], other[at + 1]]][kind]
        a, b = " ".join(words), " ".join(other)
        exact, most = distance(a, b), edits.most_edits(a, b, 0.8)
        near += 0.7 * most <= exact <= 1.3 * most
        for limit in (most, exact, exact - 1):
            assert line_dedup.edit_within(a, b, limit) == (exact <= limit)
        assert line_dedup.within([a], [b], 0.8)[0] == (exact <= most)
    assert near > 300


VOCABULARY = {"en": "the and of to in that it was for with his they this have from".split(), "de": "der die und das nicht ein sich mit auf für dem werden über schön".split(), "ru": "и в не на что он как это по но они мы этот быть".split()}


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(30)), lang) for k in range(240) for lang in [list(VOCABULARY)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r.doc_id for r in docs.where(language_id.held_out()).select("doc_id").collect()]
    assert held and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    mixed = " ".join(VOCABULARY["en"] * 2) + ". " + " ".join(VOCABULARY["de"] * 2)
    odd = language_id.predict(make_docs(spark, [*ODD, (1, mixed), (2, "123 !?")], True), model).collect()
    by = {r.doc_id: r for r in odd}
    assert by[9001].lang_pred == by[9002].lang_pred == by[2].lang_pred == "und" and by[2].score == 0
    assert [s.lang for s in by[1].spans] == ["en", "de"] and mixed[: by[1].spans[0].end].startswith(" ".join(VOCABULARY["en"]))
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in odd)
    empty = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(make_docs(spark, []), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    begins = np.array([0, 4, 4, 9, 10])
    scores = rng.normal(size=(10, 3)) * 4
    path = language_id.viterbi(scores, begins, 3.0)
    for low, high in zip(begins[:-1], begins[1:]):
        if high == low:
            continue
        value = lambda p: sum(scores[low + k, x] for k, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in np.ndindex(*([3] * (high - low))))
        assert abs(value(path[low:high].tolist()) - best) < 1e-9


ITEM = "A shop sold 12 boxes of tea to Maria on a rainy day and then sold 7 more boxes weighing 12 kg to her friend Paul before closing"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "an item about the slow growth of green moss under old stones by the river bank"), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    other = ITEM.replace("12", "30").replace("7", "9").replace("Maria", "Olga").replace("Paul", "Ivan")
    jumbled = ITEM.replace("12 boxes", "30 boxes").replace("12 kg", "45 kg").replace("7", "9")
    filler = " ".join(words(random.Random(1), 200))
    rows = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler}. {other} {filler}"), (3, filler), (4, jumbled), (5, f"x {other} y {ITEM.replace('12', '99')}")]
    docs = make_docs(spark, rows + ODD, True)
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 1)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised and got[1, 1].coverage > 0.9  # its first word looks like a name inside a sentence
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) + len(ODD) - 3
    assert decontamination.contaminated(make_docs(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_decontamination_of_short_and_bare_items(spark):
    """Items of four to eight tokens, such without plain words (their very tokens, lines taken together), and such under four tokens (whole lines)."""
    items = [(1, "12 + 7 = 19"), (2, "Paul, Maria, Olga"), (3, "how tall is a tree"), (4, "name the red and blue birds here now"), (5, "7"), (6, "What is 17 times 23?"), (7, "3 + 4 = 7\n5 + 6 = 11"), (8, "8\n9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "see\n12 + 7 = 19\nend"), (2, "see 12 + 7 = 19 end"), (3, "12 + 7 = 20"), (4, "x\nPaul Maria Olga"), (5, "we ask how tall is a tree there"), (6, "name the red and blue birds here now"), (7, "how tall is one tree"), (8, "7 up"), (9, "7"),
            (10, "some text. What is 17 times 23? more"), (11, "some text. what is 18 times 5? more"), (12, "Question: 3 + 4 = 7\n5 + 6 = 11 and so on"), (13, "3 + 4 = 7 5 + 6 = 12"), (14, "12 - 7 = 19"), (15, "a\n8\n9\nb"), (16, "a 8\n9"), (17, "12 7 19"), (18, "3 + 4 = 7 5 + 8 = 13")]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontamination.contaminated(make_docs(spark, rows + ODD, True), bench).collect()}
    assert got == {k: k == (11, 6) for k in [(1, 1), (2, 1), (4, 2), (5, 3), (6, 4), (9, 5), (10, 6), (11, 6), (12, 7), (13, 7), (15, 8)]}  # of (13, 7) two of three windows


def plain_tokens(text):
    """(token, kind) with kind word, number, unit, name or sign; whether a sentence ends before it; its line. The rule in plain Python, for ASCII."""
    out, end = [], 0
    for m in re.finditer(r"[A-Za-z0-9]+(?:(?<=\d)[.,:/-](?=\d)[A-Za-z0-9]+)*|[-+*/=<>^]", text):
        t = m.group()
        if not t[0].isalnum():
            left, right = text[: m.start()].rstrip(" \t")[-1:].isdigit(), text[m.end() :].lstrip(" \t")[:1].isdigit()
            if not (left and right if t in "-/" else left or right):
                continue
        opens = not out or any(c in ".!?:;\n" for c in text[end : m.start()])
        kind = "sign" if not t[0].isalnum() else "number" if any(c.isdigit() for c in t) else "unit" if t.lower() in decontamination.UNITS else "name" if t[0].isupper() and not opens else "word"
        out.append((t.lower(), kind, opens, text[: m.start()].count("\n")))
        end = m.end()
    return out


def plain_template(toks):
    """[(value, literal or None, is a plain word)], neighbours of one type as one."""
    out = []
    for k, (t, kind, opens, _) in enumerate(toks):
        if kind in ("word", "sign"):
            out.append((t, None, kind == "word"))
        elif k and not opens and toks[k - 1][1] == kind:
            out[-1] = (kind.upper(), out[-1][1] + (t,), False)
        else:
            out.append((kind.upper(), (t,), False))
    return out


def plain_windows(text):
    """Of an item its class and windows {place: (size, values, slots)}; and of a text all windows of any size, by size and values."""
    toks = plain_tokens(text)
    temp, bare = plain_template(toks), [t[0] for t in toks]
    edge = [k in (0, len(toks)) or toks[k][3] != toks[k - 1][3] for k in range(len(toks) + 1)]

    def at(size):
        if size > 0:
            need = 3 if 5 <= size < 8 else 4
            spans = ((k, temp[k : k + size]) for k in range(len(temp) - size + 1))
            return {k: (tuple(x[0] for x in w), tuple(x[1] for x in w if x[1])) for k, w in spans if sum(x[2] for x in w) >= need}
        return {k: (tuple(bare[k : k - size]), ()) for k in range(len(bare) + size + 1) if size <= -4 or edge[k] and edge[k - size]}

    size = min(len(temp), 8)
    own = at(size) if size >= 4 else {}
    if own:
        values = list(dict.fromkeys(x[1] for x in temp if x[1]))
        return (tuple((x[0], x[1] and values.index(x[1])) for x in temp), size), own, at
    size = -min(len(bare), 8)
    return (tuple(bare), size), (at(size) if size else {}), at


def test_decontamination_against_the_rule_in_plain_python(spark):
    rng = random.Random(11)
    vocabulary = "how many of the red boxes does take hold when is what + - * / = < 5 7 12 3.5 10-4 kg miles Paul Maria Olga\n . ? ; :".split(" ")

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    def varied(t):
        change = {a: b for names in (["5", "7", "12", "3.5"], ["Paul", "Maria", "Olga"], ["kg", "miles"]) for a, b in zip(names, rng.sample(names, len(names)))}
        return " ".join(change.get(x, x) if rng.random() < 0.97 else x for x in t.split(" "))

    items = [(k, text(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20]))) for k in range(60)]
    items += [(60 + k, varied(items[k % 60][1])) for k in range(60)]
    docs = [(k, text(rng.randrange(40)) + rng.choice([" ", "\n", ". "]) + rng.choice([lambda t: t, varied])(rng.choice(items)[1]) + rng.choice([" ", "\n"]) + text(rng.randrange(40))) for k in range(600)]
    classes = {}
    for item, t in items:
        key, own, _ = plain_windows(t)
        if own:
            classes.setdefault(key, []).append((item, own))
    expect = {}
    for doc, t in docs:
        at = plain_windows(t)[2]
        held = {size: at(size) for size in {key[1] for key in classes}}
        for key, members in classes.items():
            places, same = set(), False
            windows = members[0][1]
            first = {}
            for p, (values, slots) in held[key[1]].items():
                first.setdefault(values, []).append((p, slots))
            copies = {}
            for q, (values, slots) in windows.items():
                for p, new in first.get(values, []):
                    copies.setdefault(p - q, []).append((q, slots, new))
            for found in copies.values():
                pairs = {x for _, old, new in found for x in zip(old, new)}
                if len({a for a, _ in pairs}) == len(pairs):
                    places |= {q for q, *_ in found}
                    same |= any(all(own[q][1] == new for q, _, new in found) for _, own in members)
            if places and (len(places) >= 8 or len(places) / len(windows) >= 0.5):
                item = min(m[0] for m in members)
                assert (doc, item) not in expect
                expect[doc, item] = (len({m[0] for m in members}), len(places), len(windows), not same)
    docs = make_docs(spark, docs).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r["items"], r.matched, r.item_windows, r.reparameterised) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == expect and len(expect) > 300 and sum(v[3] for v in expect.values()) > 30 and max(v[0] for v in expect.values()) > 1
    found = {r.item_id: r.class_item for r in decontamination.template_classes(bench).collect()}
    assert found == {m[0]: min(x[0] for x in members) for members in classes.values() for m in members}


def test_decontamination_of_a_family_of_items(spark):
    """Questions of one template are one class: a row per document, not one per document and question."""
    ask = "A farmer has {} boxes of {} kg each and how many more are left when the {} of them are gone"
    bench = spark.createDataFrame([(k, ask.format(k, 2 * k + 3, 5000 + k)) for k in range(40)], "item_id long, text string")
    docs = make_docs(spark, [(k, ask.format(k, 2 * k + 3, 5000 + k)) for k in range(20, 60)])
    got = decontamination.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r["items"], r.reparameterised) for r in got) == [(k, 0, 40, k >= 40) for k in range(20, 60)]
    assert decontamination.template_classes(bench).where("class_item = 0").count() == 40


def test_decontamination_of_a_long_text_with_bare_items(spark):
    """Lines and tokens of a text over a MiB are counted through its pieces."""
    items = [(1, "12 + 7 = 19\n20 + 5 = 25"), (2, "41\n42")]
    size = decontamination.pieces.__globals__["PIECE"]
    rows = []
    for k in range(0, 60, 3):
        for item, t in items:
            rows.append((100 * item + k, "\n".join([("word and " * (size // 9))[: size - 40 + k], t, "end"])))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(make_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(doc, doc // 100) for doc, _ in rows}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(6):
        base = rng.normal(size=16)
        for _ in range(40):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.05, 0.2, 1.0])).tolist(), c % 2))
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, rows[0][1][:8], 0), (906, [None] + rows[0][1][1:], 0), (0, rows[0][1], 0)]
    kind = "vec_id long, embedding array<float>, label int"
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, kind).withColumn("rid", F.lit("x"))).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows + odd[-1:]], np.float32).astype(float)
    label = np.array([r[2] for r in rows + odd[-1:]])
    ids = [r[0] for r in rows + odd[-1:]]
    norm = np.linalg.norm(x, axis=1)
    link = ((x @ x.T) / (norm[:, None] * norm) >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    up = list(range(len(x)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in np.argwhere(link):
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    expect = sorted((i, int(n), min(ids[j] for j in range(len(x)) if top(j) == top(k))) for k, (i, n) in enumerate(zip(ids, link.sum(axis=1))))
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id < 900)
    assert sum(n for _, n, _ in found) >= 0.99 * sum(n for _, n, _ in expect) and found == expect
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id >= 900)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], kind)).count() == 0


def test_embeddings_of_any_scale_and_copies(spark):
    """Huge and tiny components, many copies (one class), labels that are no numbers."""
    base = [1.0, 2.0, -0.5, 3.0]
    rows = [(k, base, "a") for k in range(30)] + [(40, [x * 1e200 for x in base], "a"), (41, [x * 1e-200 for x in base], "a"), (42, [-x for x in base], "a"), (43, base, "b"), (44, [1.0, 2.0, -0.5, 3.01], "a"), (45, base, None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    for k in [*range(30), 40, 41, 44]:
        assert got[k] == (32, 0, k == 0)
    assert all(got[k] == (0, k, True) for k in (42, 43, 45))


def test_e8_points_are_lattice_points_and_near():
    x = np.random.default_rng(2).normal(size=(200, 8)) * 3
    first, second = embedding_dedup.e8_points(x, 2)
    for p in (first, second):
        assert ((p % 2 == 0).all(axis=1) | (p % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 4 == 0).all()
    assert (np.linalg.norm(first / 2 - x, axis=1) <= 1 + 1e-9).all()  # the covering radius


def test_chat_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "one two three four"), (1, 2, "user", "bye"), (2, 0, "user", "x"), (3, 0, None, None), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (None, 0, "user", "lost"), (4, 0, "assistant", "word")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    talks = chat_format.conversations(df)
    got = {r.conv_id: r for r in chat_format.format_preferences(chat_format.truncated_negatives(talks)).collect()}
    assert set(got) == {1, 3, 4}
    r = got[1]
    assert r.prompt_turns == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    assert [r.chosen_completion[a:b] for a, b in r.chosen_mask] == ["one two three four<|end|>\n"]
    assert [r.rejected_completion[a:b] for a, b in r.rejected_mask] == ["one two<|end|>\n"]
    assert got[3].prompt_turns == 2 and got[3].chosen_completion == got[3].rejected_completion == "" and got[3].chosen_mask == []
    t = lambda *x: [{"turn": k, "role": a, "text": b} for k, (a, b) in enumerate(x)]
    a = t(("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b"))
    pairs = spark.createDataFrame([(1, a, t(("user", "q"), ("assistant", "a"), ("user", "s"), ("assistant", "c"))), (2, a, None), (3, a, a[:2])], "conv_id long, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>")
    got = {r.conv_id: r for r in chat_format.format_preferences(pairs).collect()}
    assert got[1].prompt_turns == 2 and [got[1].chosen_completion[a:b] for a, b in got[1].chosen_mask] == ["b<|end|>\n"]
    assert got[2].prompt_turns == 0 and got[2].rejected_completion == "" and len(got[2].chosen_mask) == 2
    assert got[3].prompt_turns == 2 and got[3].rejected_completion == ""
    assert chat_format.format_preferences(chat_format.truncated_negatives(chat_format.conversations(df.where("false")))).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    """Real notices, wrapped and with comment marks, are found whole and confirmed; prose is left alone; held-out wordings are found."""
    import textwrap

    rng = random.Random(4)
    plain = [(k, "\n".join(" ".join(words(rng, 12)) for _ in range(6))) for k in range(60)]
    rows, want = [], {}
    for family in ("mit", "bsd", "apache-2.0", "gpl-3.0", "lgpl"):
        for width in (60, 76):
            for text in license_scan.TEMPLATES[family][1:3]:
                i = 1000 + len(rows)
                rows.append((i, plain[len(rows)][1] + "\n\n" + "\n".join("# " + x for x in textwrap.wrap(text, width)) + "\n\n" + plain[-1][1]))
                want[i] = family
    docs = make_docs(spark, plain + rows)
    found = license_scan.scan(docs, license_scan.train(spark, docs, 300)).collect()
    sure = {(r.doc_id, r.family) for r in found if r.confirmed}
    assert {i for i, _ in sure} <= set(want)
    assert len(sure & set(want.items())) == len(want)
    assert sum(r.n_lines > 1 for r in found) >= len(want)


def test_license_windows_do_not_depend_on_cuts(monkeypatch):
    """Texts cut every few lines have the windows of whole texts, each once, with the same lines."""
    import pyarrow as pa

    from snapweave.llm import words as word_module

    rng = random.Random(8)
    word = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "x1", "#", "..."]) for _ in range(n))
    texts = [None, "", "\n\n\n"] + ["\n".join(word(rng.choice([0, 1, 3, 9, 20, 130])) for _ in range(rng.randrange(1, 60))) for _ in range(60)]

    def found(size):
        monkeypatch.setattr(word_module, "PIECE", size)
        out = []
        for row, line, hashes, begins, paragraph, old, opens, closes in license_scan.paragraphs(pa.array(texts)):
            for a, b, k, n in zip(*license_scan.windows(begins, paragraph, old), strict=True):
                out.append((int(row[k]), int(line[k]), int(n), int(opens[a]), int(closes[b - 1]), hashes[a:b].tobytes()))
        return sorted(out)

    whole = found(1 << 20)
    assert len(whole) > 1000 and len(set(whole)) == len(whole)
    for size in (40, 150, 700, 3000):
        assert found(size) == whole


def test_license_scan_across_the_cuts_of_a_long_text(spark):
    """A wrapped notice at places around a MiB of a text without blank lines is found whole, and once."""
    import textwrap

    rng = random.Random(9)
    notice = "\n".join(textwrap.wrap(license_scan.TEMPLATES["mit"][1], 60))
    prose = "\n".join(" ".join(words(rng, 12)) for _ in range(15000))[: (1 << 20) + 5000].rsplit("\n", 1)[0]
    assert len(prose) > 1 << 20
    rows = []
    for k, back in enumerate(range(-100, len(notice) + 100, 60)):
        at = prose.rfind("\n", 0, (1 << 20) - back) + 1
        rows.append((k, prose[:at] + "\n" + notice + "\n\n" + prose[at : at + 20000], prose[:at].count("\n") + 1))
    docs = make_docs(spark, [r[:2] for r in rows])
    got = license_scan.scan(docs, license_scan.train(spark, docs.limit(2), 300)).where("confirmed").collect()
    assert sorted((r.doc_id, r.line_no, r.n_lines, round(r.template_share, 6)) for r in got) == [(k, line, notice.count("\n") + 1, 1.0) for k, _, line in rows]


def test_license_scan_of_an_empty_table(spark):
    model = license_scan.train(spark, make_docs(spark, []), 50)
    got = license_scan.scan(make_docs(spark, [(1, "Released under the MIT License."), (2, None), (3, "")]), model).collect()
    assert [(r.doc_id, r.family) for r in got] == [(1, "mit")]


def test_memory_of_a_batch_of_texts():
    """What a task of lines or of windows holds beside a batch is a few times a piece of text."""
    rng = random.Random(8)
    texts = pa.array([" ".join(words(rng, 300)) for _ in range(2000)])
    ids = pa.array(np.arange(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "row_key", "text"])
    for run in (line_dedup._lines(5, np.zeros(0, np.uint64))[0], decontamination._emit(lambda: lambda win: win < 0, [8])[0]):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 30_000_000


def test_license_sample_in_many_tasks(spark, monkeypatch):
    """Where a repartition gives more tasks than it was asked for, training ends too, with the sample of one task."""
    rng = random.Random(5)
    docs = make_docs(spark, [(k, "\n".join(" ".join(words(rng, 12)) for _ in range(3))) for k in range(60)])
    one = license_scan.train(spark, docs.coalesce(1), 40, steps=3)
    frame, written, put = type(docs), [], license_scan.Scratch.table
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c, f=frame.repartition: f(self, max(n, 40), *c))
    many = docs.repartition(40, "doc_id")

    def table(self, df, name):
        written.append(name)
        assert len(written) < 5, "it does not end"
        return put(self, df, name)

    monkeypatch.setattr(license_scan.Scratch, "table", table)
    got = license_scan.train(spark, many, 40, steps=3)
    assert got["temperature"] == one["temperature"] and np.allclose(got["weights"], one["weights"], atol=1e-3)


def test_license_scan_of_a_long_line(spark):
    """A notice inside a line of some thousand words; no part of a text is cut off."""
    rng = random.Random(6)
    grant = license_scan.TEMPLATES["mit"][1]
    docs = make_docs(spark, [(k, " ".join(words(rng, 3000))) for k in range(5)] + [(9, " ".join(words(rng, 2500)) + " " + grant + " " + " ".join(words(rng, 700)))])
    got = license_scan.scan(docs, license_scan.train(spark, docs, 300)).where("confirmed").collect()
    assert [(r.doc_id, r.family) for r in got] == [(9, "mit")]


def test_license_scan(spark):
    rng = random.Random(2)
    plain = [(k, "\n".join(" ".join(words(rng, 12)) for _ in range(4))) for k in range(60)]
    marked = [(100, plain[0][1] + "\nReleased under the MIT License.\nmore words here"), (101, "Licensed under the Apache License, Version 2.0."), (102, "All rights reserved."), (103, "x\nThis work is licensed under the GNU General Public License, version 3.")]
    docs = make_docs(spark, plain + marked + ODD, True)
    model = license_scan.train(spark, docs, 200)
    got = {(r.doc_id, r.line_no): (r.family, r.confirmed) for r in license_scan.scan(docs, model).collect()}
    assert got == {(100, 4): ("mit", True), (101, 0): ("apache-2.0", True), (102, 0): ("proprietary", True), (103, 1): ("gpl-3.0", True)}
    assert license_scan.scan(make_docs(spark, []), model).count() == 0


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(words(rng, rng.choice([1, 3, 20, 60])))) for k in range(120)] + [(500, "Don't <|endoftext|> stop here é İ ﬁ ½ 日本語   x"), *ODD]
    got = packing.pack(make_docs(spark, rows, True), TOKENIZER, 64, per_task=40).collect()
    tokenizer, text = Tokenizer.from_file(TOKENIZER), dict(rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, found in pieces.items():
        ids = np.array([*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 0], "<u4")
        times = sum(1 for j, _ in rows if j == i)
        found.sort(key=lambda r: r.piece)
        for r in found:
            assert r.start == 64 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in found) == times * len(ids)
    for v in sequences.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) * 1.05 + 2
    assert packing.pack(make_docs(spark, []), TOKENIZER).count() == 0


def test_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 101, 500)
    into = packing.best_fit(sizes, 100)
    assert np.bincount(into, weights=sizes).max() <= 100
    assert into.max() + 1 <= max(np.ceil(sizes.sum() / 100), (sizes > 50).sum()) * 1.05


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"), ("example.com", "/en/", "block")]
    urls = ["http://a.Example.com/en/x?q#f", "https://www.example.com/en/", "http://x.net/es/1", "http://x.net/fr", "no scheme", None, "", "http://", "http://com/en/", "http://notexample.com/en/", "ftp://b.www.example.com/en/y", "http://example.com", "http://a.com?x=://b.net/es/", "http://x.net/es/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit(1), "short": F.lit(2)})
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_filter.rules_table(spark, rules)).collect()}

    def expect(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for k, url in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == expect(url)
    assert url_filter.judge_urls(df, url_filter.rules_table(spark, [])).where("verdict != 'allow'").count() == 0
    assert url_filter.judge_urls(df.where("false"), url_filter.rules_table(spark, rules)).count() == 0
    plan = url_filter.judge_urls(df, url_filter.rules_table(spark, rules))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop", plan.split("Physical Plan")[-1])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = [" ".join(rng.choice(VOCABULARY["en"]) + str(rng.randrange(50)) for _ in range(60)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(text)] + [(100, text[0]), (101, text[1].replace(" ", "\n", 30) + " and a few more"), (106, text[4] + " and a few more"), (102, ITEM + " " + text[2]), (103, "123 456"), (104, None), (105, "")]
    make_docs(spark, rows, True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert left[0] == set(range(30)) | {100, 101, 102, 106}
    # 106 is one line that is alike to 4's; 101 has the words of 1, but no line of it
    assert left[1] == left[0] - {100, 106} and left[2] == left[1] - {101} and left[3] == left[2] - {102} and left[3] == left[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[4]


def test_line_dedup_finds_word_edits_of_short_lines(spark):
    """Against edit similarity alone: lines of 5 to 30 words, one to a fifth of whose words are others."""
    rng = random.Random(12)
    rows = []
    for k in range(150):
        w = words(rng, rng.randrange(5, 31))
        v = list(w)
        for at in rng.sample(range(len(v)), rng.randrange(1, max(2, len(v) // 8))):
            v[at] = words(rng, 1)[0]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    most = lambda a, b: int(round(max(len(a), len(b)) * 0.2, 6))
    alike = {k for k in range(0, 300, 2) if line_dedup.edit_within(rows[k][1], rows[k + 1][1], most(rows[k][1], rows[k + 1][1]))}
    gone = {r.doc_id for r in line_dedup.dedup_lines(make_docs(spark, rows)).where("lines_removed > 0").collect()}
    assert len(alike) > 100
    assert len(alike & {i - 1 for i in gone}) >= 0.95 * len(alike)
    assert all(i % 2 and i - 1 in alike for i in gone)


def test_rewrite_keeps_every_row(spark, tmp_path):
    """Null and repeated ids, columns of clashing names, and shards that all rows leave."""
    rows = [(None if k % 7 == 0 else k % 20, "t" * (k % 9)) for k in range(60)]
    docs = make_docs(spark, rows).withColumn("shard", F.lit("own")).withColumn("slot", F.lit("mine"))
    path = str(tmp_path / "shards")
    old = F.pmod(F.xxhash64("doc_id", "text"), F.lit(6))
    docs.select("doc_id", "text", old.cast("int").alias("shard")).write.partitionBy("shard").parquet(path)
    placed = sharding.reshard(docs, old, 6, 2)
    sharding.rewrite_shards(spark, docs, placed, path)
    back = spark.read.option("mergeSchema", "true").parquet(path)
    assert {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1}
    got = [(r.doc_id, r.text) for r in back.collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert {(r.shard_, r.slot_) for r in back.collect()} == {("own", "mine")}


def test_op1_moves_text(spark, tmp_path):
    from snapweave.llm.queries import op1_min_cost_resharding

    rows = [(k % 50 if k % 11 else None, "x" * (k % 83)) for k in range(600)]
    docs = make_docs(spark, rows).withColumn("source", F.concat(F.lit("s"), (F.length("text") % 5).cast("string")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = op1_min_cost_resharding(spark, str(tmp_path))
    assert any("/shards/shard=" in f for f in out.inputFiles())
    got = out.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    for n in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))


LONG_PLAIN = "x" * (5 << 19)  # one word of 2.5 MiB
LONG_TEXT = " ".join("w" + "".join(chr(97 + k % 5003 // d % 26) for d in (1, 26, 676)) for k in range(450_000))  # 2.2 MiB of words, one line
LONG_LINES = LONG_TEXT.replace(" waaa ", "\n")
LONG = [(1, LONG_PLAIN), (2, LONG_TEXT), (3, LONG_LINES), (4, LONG_PLAIN), (5, "é" * (3 << 19)), (6, LONG_PLAIN + " tail"), (7, "short text of five words")]


def test_texts_over_a_mebibyte(spark):
    """Every operator on texts: one document each, equal to plain Python."""
    docs = make_docs(spark, LONG)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    sets = dict(shingle_sets(LONG))
    assert len(got) == len(LONG) and all(got[i].n_shingles == len(sets[i]) for i in got)
    assert got[4].component_id == 1 and got[2].kept and got[6].kept
    out = line_dedup.dedup_lines(docs)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in LONG] and {r.doc_id: r.text for r in rows}[1] == LONG_PLAIN
    first = {}
    for at, line in normal_lines(LONG):
        first.setdefault(line, at)
    assert {r.doc_id: r.lines_removed for r in rows}[3] >= sum(first[line] != at for at, line in normal_lines(LONG) if at[0] == 3)
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(found) == len(LONG) and {r.lang_pred for r in found.values()} == {"en"} and found[1].spans[0].end == len(LONG_PLAIN)
    bench = spark.createDataFrame([(1, " ".join(LONG_TEXT.split()[300_000:300_030])), (2, "short text of five words")], "item_id long, text string")
    held = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert {(2, 1), (7, 2)} <= held <= {(2, 1), (3, 1), (7, 2)}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    packed = packing.pack(docs.where("doc_id in (2, 3, 7)"), TOKENIZER).collect()
    for i in (2, 3, 7):
        ids = np.array([*tokenizer.encode(dict(LONG)[i], add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in packed if r.doc_id == i) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in packed if r.doc_id == i)
    texts = docs.unionByName(make_docs(spark, [(8, LONG_TEXT + "\n\nReleased under the MIT License.")]))
    assert {(r.doc_id, r.family) for r in license_scan.scan(texts, license_scan.train(spark, texts, 200)).where("confirmed").collect()} == {(8, "mit")}
    assert sum(r.size for r in sharding.reshard(docs, F.lit(0), 1, 3).collect()) == sum(len(t.encode()) + 1 for _, t in LONG)


def test_language_id_of_many_languages_and_scripts(spark):
    """More lang values than a task counts for at a time; marks inside words; nothing but marks is no letter."""
    rng = random.Random(5)
    rows = []
    for k in range(70):
        own = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)]
        rows += [(len(rows) + n, " ".join(rng.choice(own) for _ in range(40)), f"l{k:02d}") for n in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model["names"]) == 70
    got = language_id.predict(docs, model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.98 * len(rows)
    starts, ends, kind, _ = language_id._words(np.frombuffer("नमस्ते दुनिया cafe\u0301s \u0301".encode("utf-32-le"), np.uint32), np.array([0, 20]))
    assert [(e - s) for s, e in zip(starts, ends)] == [6, 6, 6] and len(set(kind.tolist())) == 2


def test_language_stage_rejects_by_fit(spark):
    """Foreign scripts, an unlearned language, random letters and texts without letters go; clean documents stay, whatever their lang says."""
    rng = random.Random(13)
    known = [(k, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(40)), lang) for k in range(120) for lang in [("en", "de")[k % 2]]]
    clean = [(200, " ".join(VOCABULARY["en"] + VOCABULARY["de"]), None), (201, "the and", None), (202, "und", "en")]
    other = " ".join(rng.choice("jokin pöytäkirja kyllä yhtäkkiä myös hyppyrimäki löytyy käyttäjä".split()) for _ in range(40))
    bad = [(300, " ".join(VOCABULARY["ru"] * 2), None), (301, "你好世界", None), (302, other, None), (303, " ".join("".join(rng.choice("qxzjkvwbcfgp") for _ in range(7)) for _ in range(30)), None), (304, "12 34", "en"), (305, None, "en"), (306, "", None)]
    docs = spark.createDataFrame(known + clean + bad, "doc_id long, text string, lang string").withColumn("row_key", F.lit("x"))
    out = language_id.in_known_language(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _, _ in known + clean}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.in_known_language(nothing).count() == docs.count()
    assert language_id.in_known_language(docs.where("false")).count() == 0


def test_stages_on_empty_tables_and_nulls(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], ODD):
        docs = make_docs(spark, rows, True).withColumn("lang", F.when(F.col("doc_id") == 9006, "fr"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= max(len(rows), 60_000) and (name == "packing" or out.columns == docs.columns)


ODD_WORDS = [f"{a}{b}" for a in ("alpha", "beta", "gamma,", "\u00e9t\u00e9", "x-") for b in range(400)]


def test_packing_holds_little_and_keeps_nothing_after_a_task():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    texts = [" ".join(rng.choice(ODD_WORDS) for _ in range(400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    list(packing._cut(path, 2048)(iter([batch.slice(0, 1)])))  # the tokenizer is loaded
    tracemalloc.start()
    rows = sum(b.num_rows for b in packing._cut(path, 2048)(iter([batch])))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows >= 2000 and peak < 24 << 20 and held < 1 << 20
    assert not packing._ids(path).young and not packing._ids(path).old

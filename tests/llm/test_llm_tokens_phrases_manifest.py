"""Byte-level BPE against tiktoken, phrases against a count in plain Python, and the Merkle manifest against a tree built by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from snapweave.llm import byte_bpe, collocations, merkle, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"
_rnd = random.Random(5)


def letters(n: int, of: str) -> str:
    return "".join(_rnd.choice(of) for _ in range(n))


def test_bpe_is_tiktokens_on_odd_texts(spark):
    texts = [None, "", "a", " ", "it's we'll \t\n x y 　 \u0085 ​ \U0001f600 ñandú 12345٣ ½", "\x00\x01 \x7f �", "a" * 3000, "=" * 1000, "日本語の" * 100, letters(3000, "abcdefgh"), " " * 500 + "x", "".join(map(chr, range(0x20, 0x700)))]
    rows = spark.createDataFrame([(k, t, "kept", None, None) for k, t in enumerate(texts)] + [(1, "twice", None, None, None)] * 2, SCHEMA)
    got = byte_bpe.decode(byte_bpe.encode(rows, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(got) == len(texts) + 2 and {r.lang for r in got} == {"kept", None}
    for r in got:
        text = "twice" if r.lang is None else texts[r.doc_id] or ""
        assert r.ids == TIKTOKEN.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_bpe_of_texts_over_a_mib(spark):
    texts = ["word and more, " * 80_000, letters(40_000, "abcdefghijklmnopqrstuvwxyz")]
    got = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect()
    assert all(r.ids == TIKTOKEN.encode_ordinary(texts[r.doc_id]) for r in got) and len(got) == 2


def test_bpe_query_on_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
    assert collocations.collocations(none).count() == 0
    assert merkle.manifest(none, F.col("source"), F.col("doc_id"), merkle.leaf_digest(F.col("text")), {"doc_id": F.col("doc_id")}).count() == 0


def by_hand(rows: list[tuple], top: int, least: int) -> list[tuple]:
    """Rows (text, lang) to the phrases of the contract."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^ \t]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        n, found = sum(f for p, f in own.items() if len(p) == 1), []
        often = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        for p, a in often.items():
            score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            longer = any(100 * f >= 80 * a for q, f in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_of_all_routes(spark):
    words = ["of", "the", "Of", "qé", "x y", *"abcdefg"]
    rows = [(" ".join(_rnd.choices(words, [9, 9, 3, *[1] * 9], k=_rnd.randrange(0, 60))) + _rnd.choice([". ", "\n", "", "\tz;"]) * 3, _rnd.choice(["en", "fr", None, "und"])) for _ in range(400)]
    rows += [("one hot line of the text", "en")] * 500 + [(None, "en"), ("", "de"), ("?!", "de"), ("of the " * 30_000, "fr"), ("z" * 1_300_000, "es")]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = by_hand(rows, 50, 30)
    for sizes in ({}, {"each": 300, "share": 20}, {"each": 2000, "share": 4}):
        assert sorted(map(tuple, collocations.collocations(table, top=50, **sizes).collect())) == want


def tree(digests: list[str]) -> tuple[str, list[list[tuple]]]:
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, own in enumerate(at):
            run = digests[own // 16 * 16 : own // 16 * 16 + 16]
            paths[k].append((run[: own % 16], run[own % 16 + 1 :]))
            at[k] = own // 16
        digests = [hashlib.sha256("".join(digests[k : k + 16]).encode()).hexdigest() for k in range(0, len(digests), 16)]
    return digests[0], paths


def proofs(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) to the contract's columns."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda i, t, la, so, n: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, so, la, n, t)))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    keys, out = sorted(groups, key=lambda s: (s is not None, (s or "").encode())), []
    trees = [tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys]
    root, tops = tree([t[0] for t in trees])
    for key, (subroot, paths), top in zip(keys, trees, tops, strict=True):
        for (*_, own, r), path in zip(sorted(groups[key], key=lambda x: x[:3]), paths, strict=True):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            at = leaf(r[0], text, *r[2:])
            for before, after in path + top:
                at = digest("".join([*before, at, *after]))
            out.append((r[0], own, subroot, root, digest("".join("".join(b + a) for b, a in path + top)), at, at == root))
    return sorted(out, key=str)


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(k, "AbC É", "en", "a", 3) for k in range(4500)] + [(7, "AbC É", "en", "a", 3)] * 20 + [(None, None, None, None, None)] * 3
    rows += [(1, None, None, "b", 0), (None, "", "x", "", 1), (5, "É", "é", "2", 2), *((k, "X", None, f"s{k}", 1) for k in range(40))]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == proofs(rows)


def test_manifest_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = queries.op13_merkle_manifest(spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=str) == proofs(rows) and 0 < sum(r.verified for r in got) < len(got)


def test_byte_bpe_of_a_small_table_uses_all_cores(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").repartition(8)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
        assert out.rdd.getNumPartitions() >= min(8, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)

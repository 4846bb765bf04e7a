"""Alignment of tokenizers, fill-in-middle and packing by swaps, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tabscore.llm import alignment, infilling, oracles, swap_packing
from tabscore.llm.queries import queries
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA, prose, rows

ODD = [
    "a  b", " leading and trailing ", "tab\tand\nline \n end", "x y　z​  w", "\r\n", " ", "   ", "<|endoftext|> and<|endoftext|>", "</s> <s><unk> <0x41>", "▁block ▁", "nul \x00 byte \x1c sep",
    "ﬁ ① é é", "東京 の text", "👩‍👩‍👧 emoji 🤖", "don't I'll we've 's", "under_score x=1;y[2]", "a" * 3000, "ab " * 2000, "1234567890 " * 50, "word\u0085next", "é" * 700 + " end", "<P>", "x<S>y", "cut <M>", "<<P", "a<S", "M> b <",
]


def table() -> list[tuple]:
    return rows() + [(100 + i, t, "en", "odd", 0) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(table(), SCHEMA).repartition(3)
    for name in ("n", "form", "output", "groups", "pairs", "part", "nth", "length", "base", "piece", "start"):
        d = d.withColumn(name, F.lit("clash"))
    return d.persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others come after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned(text: str | None, a: Tokenizer, b: sentencepiece.SentencePieceProcessor) -> list[tuple[list[int], list[int]]]:
    """Groups by plain sets of ends."""
    if not text:
        return []
    value, want = byte_values(), (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(value[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(ba) != want or b"".join(bb) != want:
        return []
    ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (ba, bb)]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        m, n = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append((ia[i:m], ib[j:n]))
        i, j = m, n
    return out


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def digests_of(texts: list[tuple], tokenizers) -> list[tuple]:
    groups = [(doc_id, aligned(text, *tokenizers)) for doc_id, text in texts]
    count = Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    best: dict[int, int] = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, g in groups:
        links = [count[a[-1], b[-1]] == best[b[-1]] for a, b in g]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(links), sum(count[a[-1], b[-1]] for a, b in g), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(docs, empty, tokenizers):
    found = alignment.alignment(docs)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == digests_of([r[:2] for r in table()], tokenizers)
    assert alignment.alignment(empty).count() == 0
    some = spark_rows(docs, [116, 117, 109, 107, 115, 101])
    assert {r["doc_id"] for r in alignment.alignment(some).filter("n_a = 0").collect()} == {109}


def spark_rows(docs, ids):
    return docs.filter(F.col("doc_id").isin(ids))


def test_alignment_groups_cover_every_byte(docs, tokenizers):
    text = {r[0]: r[1] for r in table() if r[0] and r[0] >= 100}
    for doc_id, groups in alignment.align(docs.filter("doc_id >= 100")).select("doc_id", "groups").collect():
        want = aligned(text[doc_id], *tokenizers)
        assert [(list(g["a"]), list(g["b"])) for g in groups] == want
        if want:
            assert groups[0]["start"] == -1 and groups[-1]["end"] == len(text[doc_id].encode()) and all(g["end"] == h["start"] for g, h in zip(groups, groups[1:], strict=False))


def test_alignment_query_on_the_given_table(spark, tokenizers):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = queries()["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == digests_of(texts, tokenizers)


def test_alignment_of_any_characters(tokenizers):
    aligner, rng = alignment.Aligner(), random.Random(4)
    letters = "ab Z1'_.,;\n\t  　éß東👩́\x1c\x85-"
    for _ in range(400):
        text = "".join(rng.choices(letters, k=rng.randint(1, 30)))
        found = aligner.align(text)
        got = found.text(aligner.digits).decode() if found else ""
        assert got == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in aligned(text, *tokenizers)), repr(text)
        assert found is None or len(found.labels) == len(text.encode()) + 1 and found.labels.endswith(b"#")


def test_pairs_are_bounded_by_the_vocabularies(spark, docs):
    most = alignment.most_pairs()
    assert most < 500_000
    stored = alignment.linked(docs).persist()
    size = alignment.Pieces(alignment.B).size
    pairs, n, _ = alignment.pair_counts(stored, size)
    assert len(pairs) <= most and n.sum() == stored.agg(F.sum("n_links")).first()[0]
    aligner = alignment.Aligner()
    for p in pairs.tolist():
        a, b = aligner.a.plain.decode_single_token_bytes(p // size), aligner.b.bytes[p % size]
        assert a.endswith(b) or b.endswith(a)
    stored.unpersist()


# 12


def filled(doc_id, text: str) -> tuple:
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    n, sha = len(text), lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_fill_in_middle(docs, empty):
    found = infilling.digests(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted((filled(r[0], r[1] or "") for r in table()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infilling.digests(empty).count() == 0


def test_fill_in_middle_sql(spark, docs):
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").filter("doc_id is null or doc_id <> 110").toArrow())  # SQL's strings end at no NUL, but its hashes may
    want = sorted(db.sql(oracles.FILL_IN_MIDDLE).fetchall(), key=str)
    assert sorted((tuple(r) for r in infilling.digests(docs.filter("doc_id is null or doc_id <> 110")).collect()), key=str) == want


@pytest.mark.parametrize("unit", ["codepoint", "word", "line"])
def test_fill_in_middle_cuts_between_units_and_reads_back(spark, unit):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(150)] + ["", "\n", "a\n\nb\n", " x ", "<P>", "é東\n👩"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    cut = infilling.fill_in_middle(d, unit=unit, seed=7, rate=100, suffix_first=50)
    for r in cut.withColumn("back", infilling.restore(F.col("output"), F.col("form"))).collect():
        text = texts[r["doc_id"]]
        assert r["back"] == text
        edges = infilling.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit)
        assert len(edges) == r["n"] + 1
        if r["form"] != "plain":
            assert r["prefix_chars"] in edges and r["prefix_chars"] + r["middle_chars"] in edges
        if unit == "line" and text:
            assert [text[a:b] for a, b in zip(edges, edges[1:], strict=False)] == text.splitlines(keepends=True) or any(c in text for c in "\x0b\x0c\x1c\x85 ")
    with pytest.raises(ValueError, match="unit is"):
        infilling.fill_in_middle(d, unit="page")


# 13


def checked(pieces: list, texts: list[tuple], window: int) -> int:
    """The number of sequences, once all pieces are found right."""
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in texts:
        ids = [*a.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % window or window
        edges = [0, *range(first, len(ids), window), len(ids)]
        for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            want[doc_id, k, x, y - x, zlib.crc32(struct.pack(f"<{y - x}I", *ids[x:y]))] += 1
    assert Counter(tuple(r)[:5] for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(bins)


@pytest.mark.parametrize("window", [1024, 64, 1])
def test_swap_packing(docs, empty, window):
    found = swap_packing.pack_by_swaps(docs, window=window)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = found.collect()
    n = checked(pieces, [r[:2] for r in table()], window)
    total = sum(r["length"] for r in pieces)
    assert n <= -(-total // window) + 1
    assert swap_packing.pack_by_swaps(empty).count() == 0


def test_swap_packing_query_on_the_given_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    pieces = queries()["op13_swap_packing"](spark, "/root/testdata/sf0.001").collect()
    n = checked(pieces, texts, 1024)
    assert n <= -(-sum(r["length"] for r in pieces) // 1024) + 1
    again = queries()["op13_swap_packing"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))


def fewest_bins(items: tuple[int, ...], window: int) -> int:
    """By trying all ways, for a few pieces."""
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= window and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def held(bins: dict) -> Counter:
    out = Counter()
    for kind, n in bins.items():
        for length, times in kind:
            out[length] += times * n
    return out


def test_local_search_against_all_ways():
    rng, excess = random.Random(2), 0
    for _ in range(150):
        window = rng.choice([20, 50, 100])
        items = tuple(sorted((rng.randint(1, window) for _ in range(rng.randint(1, 9))), reverse=True))
        bins = swap_packing.packed(Counter(items), window)
        assert held(bins) == Counter(items) and all(0 < swap_packing.fill_of(k) <= window for k in bins)
        excess += sum(bins.values()) - fewest_bins(items, window)
    assert 0 <= excess <= 3


def test_local_search_empties_bins_that_best_fit_leaves():
    rng = np.random.default_rng(1)
    for low, high, n in ((200, 700, 20_000), (300, 500, 2_000), (100, 400, 5_000)):
        counts = Counter(rng.integers(low, high, n).tolist())
        first, last = swap_packing.best_fit(counts, 1024), swap_packing.packed(counts, 1024)
        assert held(first) == held(last) == counts
        assert sum(last.values()) < sum(first.values())
        squares = lambda bins: sum(swap_packing.fill_of(k) ** 2 * m for k, m in bins.items())
        assert squares(last) > squares(first)


def test_a_length_of_millions_of_pieces_is_one_range():
    bins = swap_packing.packed({400: 10_000_000, 300: 5_000_000, 130: 7, 1: 3, 1024: 9}, 1024)
    assert held(bins) == {400: 10_000_000, 300: 5_000_000, 130: 7, 1: 3, 1024: 9}
    assert sum(bins.values()) <= 6_250_000 + 9 + 2
    plan = swap_packing.plan_of(bins)
    assert len(plan) < 60 and plan.tolist() == sorted(plan.tolist())

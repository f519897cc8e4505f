"""Operators 11 to 13 against brute force: own loops over whole texts, tiktoken, hashes built by hand."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, bpe, merkle, packing, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "  two  blanks ", "\n\n x\t y \r\n", "it's we'll they're 'd x''s '", "<|endoftext|> and <s> text", "a▁b", "é漢字😀 １２ ½ ﬁ", "\x00 nul", "x" * 3000, "word " * 4000, "'" * 70 + "ll"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents table holds odd texts, null ids and columns, repeated rows and further columns."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None), (None, "no id", None, None, None), (3, "  two  blanks ", "en", "s0", 14), (3, "another text", None, "s0", None), (5, "ÄÖ Upper Case", "de", "", 13)]
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit(1), "at": F.lit("x"), "block": F.lit(2), "link": F.lit(3), "ids": F.lit("y")})
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    df.where("false").write.parquet(f"{path}/none/documents.parquet")
    return str(path), rows


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def real_rows(spark, n=200):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()][:n]


# ---- byte-level BPE


def by_tiktoken(rows):
    ranks = bpe.codec(RANKS).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(own.decode_bytes(ids))))
    return sorted(out, key=str)


def test_bpe_query_equals_tiktoken(spark, odd):
    path, rows = odd
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, path).collect()), key=str) == by_tiktoken(rows)
    assert queries.op12_byte_bpe(spark, f"{path}/none").count() == 0
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()), key=str) == by_tiktoken(real_rows(spark, None))


def test_splits_equal_the_pattern():
    own = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    codec, rng = bpe.codec(RANKS), random.Random(5)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["".join(rng.choice("aabltsvredmL'' \n\t  !?1२é漢😀\x1c中ſʼ ") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)]
    for t, (ids, offsets, first) in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        got = np.frombuffer(ids, "<i4")
        assert got.tolist() == whole.encode_ordinary(t)
        assert codec.decode(got, offsets, first) == t.encode()
        assert own.decode_bytes(own.encode_ordinary(t)) == t.encode()


def test_long_slices_merge_as_short_ones():
    codec, rng = bpe.codec(RANKS), random.Random(6)
    pieces = ["".join(rng.choice("abething") for _ in range(rng.randrange(1, 49))).encode() for _ in range(500)]
    short = codec.merge_short(pieces, 48)
    assert [codec.merge_long(p).tobytes() for p in pieces] == short


def test_offsets_and_order_are_checked_on_decoding():
    codec = bpe.codec(RANKS)
    ids, offsets, first = next(codec.encode([b"several words here"]))
    got = np.frombuffer(ids, "<i4")
    with pytest.raises(ValueError):
        codec.decode(np.append(codec.single[65], got), offsets, first)
    assert codec.decode(got[first[1] : first[2]], np.array([0]), np.array([0])) == b" words"


def test_transitions_compose_in_any_grouping():
    after, _ = bpe.transitions()
    rng = np.random.default_rng(1)
    a, b, c = (after[rng.integers(0, 9, 50)] for _ in range(3))
    assert np.array_equal(bpe.compose(bpe.compose(a, b), c), bpe.compose(a, bpe.compose(b, c)))


def test_invalid_bytes_are_read_as_replacements(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(x'61ff62' as string)").alias("text"))
    assert bytes(bpe.decode(bpe.encode(df, RANKS), RANKS).first().decoded) == "a�b".encode()


# ---- alignment


def aligned_by_hand(rows):
    """Groups from sets of ends, all links of each group in nested loops, counts over whole rows."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_alphabet()
    token = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, held = [], Counter()
    for r in rows:
        t = r[1] or ""
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        if not t or b"".join(map(token, ia)) != (" " + t).encode() or b"".join(map(piece, ib)) != (" " + t).encode():
            out.append((r[0], [], [], [], []))
            continue
        ends = []
        for ids, of in ((ia, token), (ib, piece)):
            at, e = 0, []
            for i in ids:
                at += len(of(i))
                e.append(at)
            ends.append(e)
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((ia[i:p], ib[j:q]))
            i, j = p, q
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        out.append((r[0], ia, ib, groups, links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    text = lambda gs: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
    return sorted([(d, len(ia), len(ib), len(gs), len(ls), sum(held[x] == most[x[0]] for x in ls), sum(held[x] for x in ls), sha(text(gs)) if ia else "") for d, ia, ib, gs, ls in out], key=str)


def test_alignment_query_matches_brute_force(spark, odd):
    path, rows = odd
    assert sorted(map(tuple, queries.op11_token_alignment(spark, path).collect()), key=str) == aligned_by_hand(rows)
    assert queries.op11_token_alignment(spark, f"{path}/none").count() == 0
    assert sorted(map(tuple, queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()), key=str) == aligned_by_hand(real_rows(spark, None))


def test_alignment_in_small_blocks_and_memories(spark, odd, monkeypatch):
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    path, rows = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(docs, a, b, remembered=4, block_links=3)
    kept = alignment.written(found, "aligned")
    assert kept.select("block").distinct().count() > 5
    got = alignment.scored(kept, alignment.link_counts(kept))
    want = [x[:-1] for x in aligned_by_hand(rows)]
    assert sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got.collect()], key=str) == want


def test_large_groups_expand_by_distinct_ids(monkeypatch):
    own = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["ﬁﬁﬁ x ｆｕｌｌ", "😀😀 中中"]
    before = [alignment.distinct_links(x[1], x[2]) for x in own.align(texts)]
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    own.young, own.old = {}, {}
    after = [alignment.distinct_links(x[1], x[2]) for x in own.align(texts)]
    assert all(np.array_equal(p, q) for x, y in zip(before, after, strict=True) for p, q in zip(x, y, strict=True))


# ---- manifest


def manifest_by_hand(rows, fan_out=16):
    part = lambda v: b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()
    leaf = lambda d, t, l, s, n: sha(b"".join(map(part, (d, s, l, n, t))))
    down = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def tree(nodes):
        """The root, and of each node the siblings before and after it, level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, i in zip(paths, at, strict=True):
                run = i // fan_out * fan_out
                p.append((nodes[run:i], nodes[i + 1 : run + fan_out]))
            nodes = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)]
            at = [i // fan_out for i in at]
        return nodes[0], paths

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r, leaf(*r)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = tree([x[1] for x in by_source[s]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, more in zip(order, above, strict=True):
        for (r, h), path in zip(by_source[s], trees[s][1], strict=True):
            whole = path + more
            acc = leaf(r[0], r[1].translate(down) if r[1] is not None else None, *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else h
            for left, right in whole:
                acc = sha("".join([*left, acc, *right]))
            out.append((r[0], h, trees[s][0], root, sha("".join(x for p in whole for side in p for x in side)), acc, acc == root))
    return sorted(out, key=str)


def test_manifest_query_matches_brute_force(spark, odd):
    path, rows = odd
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, path).collect()), key=str) == manifest_by_hand(rows)
    assert queries.op13_merkle_manifest(spark, f"{path}/none").count() == 0


def test_manifest_of_a_hot_source_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 60)
    rng = random.Random(3)
    rows = [(i, f"Text {rng.randrange(400)}", "en", "hot" if i % 3 == 0 else f"s{i % 40}", 5) for i in rng.sample(range(5000), 1200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == manifest_by_hand(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_small_runs(spark):
    one = spark.createDataFrame([(1, "x", None, "s", 1)], SCHEMA)
    r = merkle.verified(merkle.manifest(one, ["doc_id", "text"], "source", "doc_id")).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:11:x") and r.path == []
    many = spark.createDataFrame([(i, "x", None, "s", 1) for i in range(11)], SCHEMA)
    rows = merkle.verified(merkle.manifest(many, ["doc_id", "text"], "source", "doc_id", fan_out=2)).collect()
    assert len({r.root for r in rows}) == 1 and all(r.verified for r in rows) and {len(r.path) for r in rows} == {4}


# ---- packing: the program's start over many lengths, inside a session


def test_packing_of_a_thousand_lengths(spark):
    """1,022 different lengths are left over; the basis is inverted on the driver beside a running JVM."""
    docs = spark.range(1, 1023).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" a"), F.col("id").cast("int")).alias("text"))
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "length", "doc_tokens", "sequence_id", "offset").collect()
    assert len(packed) == 1022 and all(r.length == r.doc_tokens == r.doc_id + 1 for r in packed)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.03 * sum(used.values()) / 1024 + 1


def test_inverses_and_equal_counts():
    rng = np.random.default_rng(2)
    order = rng.permutation(40).tolist()
    basis = np.zeros((40, 40))
    for k, row in enumerate(order):
        basis[row, : k + 1] = rng.integers(0, 3, k + 1)
        basis[row, k] = rng.integers(1, 4)
    for inverse in (packing.triangular_inverse(basis, order), packing.inverse_of(basis)):
        assert np.abs((inverse[:, :, None] * basis[None]).sum(1) - np.eye(40)).max() < 1e-6
    # equal counts tie in every step; a gap of nothing makes the program run to its end, with a new inverse on the way
    lengths = np.arange(300, 420, 2)
    patterns, x = packing.column_generation(lengths, np.full(len(lengths), 30), gap=0.0, refactor=5)
    assert np.allclose((patterns * x[:, None]).sum(0), 30, atol=1e-3) and (patterns @ lengths <= 1024).all()

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import packing, tiles

import public_tokenizers


def one_by_one(lengths: list[int], size: int) -> int:
    """How many sequences best-fit decreasing opens, piece by piece."""
    room: list[int] = []
    for length in sorted(lengths, reverse=True):
        fitting = [k for k, r in enumerate(room) if r >= length]
        if fitting:
            room[min(fitting, key=lambda k: room[k])] -= length
        else:
            room.append(size - length)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 41, 64]))
def test_plan_is_best_fit_decreasing(lengths, size):
    counts = Counter(lengths)
    plan = packing.plan(dict(counts), size)
    assert plan.sequences == one_by_one(lengths, size)
    held: dict[int, list] = {}
    for length, n in counts.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            held.setdefault(s, []).append((o, length))
    assert sorted(held) == list(range(plan.sequences))
    for members in held.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size


def test_tree_finds_the_tightest():
    tree, rng, present = packing.Capacities(2048), random.Random(5), set()
    for _ in range(3000):
        c = rng.randint(1, 2048)
        tree.put(c, c not in present)
        present ^= {c}
        least = rng.randint(1, 2048)
        assert tree.tightest(least) == min((p for p in present if p >= least), default=None)


ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "\na", "a\n", "It's we'll I'd", "x y z", "éa ́b", "ΣΣ Σ", "\U0001f600 ok", "12 345,6",
    "a\tb c", "<|endoftext|> a <|startoftext|>b", "Ünïcödé ẞ", "a\x1cb c", "a b c", "ﬁ ＡＢ", "word, (word) word." * 3, "a" * 5000, "x y " * 3000, "\r\n a\r\n",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tiles_give_what_the_library_gives(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, encoder, rng = Tokenizer.from_file(path), tiles.Encoder(path), random.Random(1)
    texts = ODD + ["".join(rng.choices([*"abS, .'\n  éİǰß1२<|>\t(", "́", "'s", "the ", "word", " ", "<|endoftext|>"], k=rng.randint(0, 30))) for _ in range(3000)]
    for part in (texts, texts[:1], texts[1:4], []):
        ids, lengths = encoder(pa.array([t.encode() for t in part], pa.binary()))
        wanted = [plain.encode(t, add_special_tokens=False).ids for t in part]
        assert lengths.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [x for w in wanted for x in w]


def test_chunks_keep_all_rows():
    texts = [b"x" * n for n in (0, 5, 10, 1, 0, 100, 3, 3, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.binary())], ["a", "t"])
    found = list(tiles.chunks(iter([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)]), 1, 10))
    assert [t for c in found for t in c.column(1).to_pylist()] == texts and [a for c in found for a in c.column(0).to_pylist()] == list(range(9))
    assert len(found) > 2


def test_packed(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = [None, "", "", *(" ".join(rng.choices(["alpha", "beta,", "Gamma", "1234", "\n"], k=rng.randint(0, 120))) for _ in range(150)), "long " * 4000, "same", "same"]
    rows = [(None if k == 7 else min(k, 152), t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    size = 64
    placed = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), 0, size)
    got = placed.collect()
    wanted, lengths = Counter(), []
    for doc_id, text, _ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), size):
            own = np.array(ids[p : p + size], "<u4").tobytes()
            wanted[(doc_id, p // size, p, len(own) // 4, own)] += 1
            lengths.append(len(own) // 4)
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == wanted
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    assert len(held) == one_by_one(lengths, size)
    for r in packing.sequences(placed).collect():
        own = sorted(held[r.sequence_id])
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == r.length <= size
        assert bytes(r.ids) == b"".join(i for _, _, i in own)
    assert packing.packed(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 0, size).count() == 0


def test_query(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.op12_packing(spark, folder).collect()
    wanted, lengths = set(), []
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            own = np.array(ids[p : p + 2048], "<u4")
            wanted.add((doc_id, p // 2048, p, len(own), zlib.crc32(own.tobytes())))
            lengths.append(len(own))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == wanted and len(got) == len(wanted)
    assert len({r.sequence_id for r in got}) == one_by_one(lengths, 2048)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_tiles_go_through_one_conversion(name):
    encoder = tiles.Encoder(public_tokenizers.path(name))
    assert encoder.ascii_same
    words = ["A", " A", "abc", " Straße", "Café", " İstanbul", "12", " ...", " don't", "ſee", "K", " Käse", "zz"]
    rows = encoder._fresh([w.encode() for w in words])
    for word, row in zip(words, rows, strict=True):
        assert np.frombuffer(row, encoder.width).tolist() == encoder.whole(word.encode()).tolist()

"""Token files against the tokenizers library, one text at a time."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskflow.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "The cat sat.\nOn a mat, it's fine", "", None, "  two  spaces ", "tab\tand\n\nblank lines\n", "été 日本語 ﬁ <|endoftext|> x",
    "no break space   x", "a\n b", "a \nb", "word " * 3000, "x" * 5000, "\n", " ", "'s 'll ' s", "same", "same",
]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 3], list(range(1000))])
def test_packing_returns_the_values(values):
    values = np.array(values, "<u4")
    assert T.unpack(*T.pack(values), len(values)).tolist() == values.tolist()


def test_files_match_plain_encoding(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "no id", "extra"), (3, "id again", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(5)
    files, ranked, width = T.encode(docs, PATH, 2)
    got = T.decode(files, ranked, width, files.count()).collect()
    whole = Tokenizer.from_file(PATH)
    ids = {(d, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t, _ in rows}
    want = sorted((d if d is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    seen = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got)
    assert seen == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    numbers = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert numbers == sorted(numbers)


def test_empty_table(spark):
    files, ranked, width = T.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert T.decode(files, ranked, width, files.count()).collect() == []

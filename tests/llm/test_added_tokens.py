import public_tokenizers
import pytest
from stratagraph.llm import tokenise
from tokenizers import Tokenizer

MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "x<|endoftext|>y", " <|endoftext|>  ", "<|endoftext|><|startoftext|>\n"]
TEXTS = ["plain words, first", "", *[f"a {m} b" for m in MARKS], *MARKS, "Ärger 日本 <|endoftext|> É\n\n<|startoftext|>", "<|endoftext|> " * 50, "last plain words"]


@pytest.mark.parametrize("file, encoder", [("byte_bpe_50k.json", tokenise.ByteEncoder), ("word_bpe_49k.json", tokenise.WordEncoder)])
def test_ids_equal_an_unchanged_library(file, encoder):
    path = public_tokenizers.path(file)
    library, own = Tokenizer.from_file(path), encoder(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    if encoder is tokenise.ByteEncoder:
        assert [own.encode(t).tolist() for t in TEXTS] == want
    else:
        ids, ends = own.encode(TEXTS)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
        assert own.encode(["no added token"])[0].tolist() == library.encode("no added token", add_special_tokens=False).ids


def test_operators_equal_an_unchanged_library(spark):
    import zlib

    import numpy as np
    from stratagraph.llm import packing, token_files

    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    library = Tokenizer.from_file(token_files.default_tokenizer())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.round_trip(df).collect()}
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in TEXTS]
    assert got == {i: (len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(want)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {r.doc_id: r.doc_tokens for r in packing.pack(df).collect()}
    assert total == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}

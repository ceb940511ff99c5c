"""Ids of texts that hold added tokens against a fresh tokenizer of the library."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from billoom.llm import packing, sstable
from billoom.llm.queries import vocabulary

TEXTS = ["end of file <|endoftext|> next", "end<|endoftext|>next", "<|endoftext|>", "  <|endoftext|>  <|endoftext|><|startoftext|> a", "<|startoftext|>The cat.<|ENDOFTEXT|> <|endoftext |>", "plain text, of the cat.", ""]


def test_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    byte, word = (Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = lambda x: np.frombuffer(x, "<u4").tolist()
    got = sstable.read_tables(sstable.write_tables(docs, vocabulary("byte_bpe_50k.json"), shards=2)).collect()
    assert {r["doc_id"]: ids(r["ids"])[:-1] for r in got} == {k: byte.encode(t, add_special_tokens=False).ids for k, t in enumerate(TEXTS)}
    got = packing.pieces(docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()
    assert {r["doc_id"]: ids(r["ids"])[:-1] for r in got} == {k: word.encode(t, add_special_tokens=False).ids for k, t in enumerate(TEXTS)}

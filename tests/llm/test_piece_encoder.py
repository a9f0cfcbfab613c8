"""Columns of texts give the ids of whole texts, and each distinct unit of them is encoded once."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftlens.llm import tokenize
from driftlens.llm.queries_text import tokenizer_file

VOCABULARY = tokenizer_file("word_bpe_49k.json")
PARTS = ["The", "été", "ÑANDÚ", "straße", "x", "7", "it's", "don'T", ".", "!!", "$$$", "|", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", " ", "  ", "\n", "\t", "\r", "\x0b", "\xa0", "　", "é", "J̌", "İ", "ΣΑΣ", "слово", "数", "ª", "̸", "\x00", "-", "_", "😀"]


def columns():
    drawn = random.Random(7)
    return [["".join(drawn.choices(PARTS, k=drawn.randrange(30))) for _ in range(80)] + ["", " "] for _ in range(4)] + [[], [""]]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("remembered", [500_000, 3])
def test_ids_are_those_of_whole_texts(monkeypatch, kind, remembered):
    monkeypatch.setattr(tokenize, "REMEMBERED", remembered)
    monkeypatch.setattr(tokenize, "TEXTS", 2000)
    library, found = Tokenizer.from_file(VOCABULARY), tokenize.PieceEncoder(VOCABULARY)
    for texts in columns():
        whole, got = pa.array([*texts, "left out"], kind).slice(0, len(texts)), []
        for first, n in tokenize.slices(whole):
            got += found.ids(whole.slice(first, n), 2).to_pylist()
        assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_each_unit_is_encoded_once():
    found, calls = tokenize.PieceEncoder(VOCABULARY), []
    whole, unit = found._whole, found._unit
    found._whole, found._unit = lambda p: calls.append(p) or whole(p), lambda p: calls.append(p) or unit(p)
    found.ids(pa.array(["Çava çava, ÇAVA!! çava.", "ordinateur", "(9) 'çava"]), 2)
    found.ids(pa.array(["ordinateur, Çava! (9) ordinateur."]), 2)
    assert sorted(calls) == ["!!", "'çava", "(9)", "ordinateur", "çava"]


def test_added_tokens_of_letters_alone(spark, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    library.add_special_tokens(["PAD"])
    library.save(path := str(tmp_path / "vocabulary.json"))
    texts = ["PAD one PAD. two", "pad xPADx", "(PAD)", "<|endoftext|>PAD"]
    rows = tokenize.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 2).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}

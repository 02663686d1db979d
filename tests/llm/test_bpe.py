import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioworks.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " \n ", "Hello, World's best 12 don'T", "<|startoftext|>Hi<|endoftext|> <|end", "İSTANBUL ΣΑΣ Ὀδυσσεύς ﬁ é ñ ŉ ß ẞ Ǆ", "日本語 🙂👍🏽 العربية ١٢٣ ½²③Ⅳ",
    "x" * 5000, "ab" * 3000 + "é" * 100, "a\x1cb\x85c d e", "'S 'LL '''s ''re ????!!! $$$", "naïve café Straße", "� \U0010ffff",
]


def test_equals_the_library():
    own, library = bpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == ids, text[:40]
        assert own.decode(packed).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_and_short_merges_agree(monkeypatch):
    words = ["internationalization", "antidisestablishmentarianism", "aaaaaaaaaaaaaaaa", "strengths"]
    short = [bpe.WordBpe(PATH).encode(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.WordBpe(PATH).encode(w) for w in words] == short


def test_cuts_lie_in_no_token():
    own = bpe.WordBpe(PATH)
    assert 0.5 < 1 - own.joined.mean() < 1
    for token in list(own.tokens[512:3000]):
        data = [own.symbols.index(c) for c in token.decode().removesuffix(own.end)]
        assert not own._cuts(bytes(data)) if len(data) > 1 else True


def test_words_come_back():
    own = bpe.WordBpe(PATH)
    assert own.restore(own.encode("Hello, <|endoftext|>World 12")) == "hello , <|endoftext|>world 1 2 "


@pytest.mark.parametrize("kept", [2, 1 << 19])
def test_columns(spark, kept, monkeypatch):
    rows = [*enumerate(TEXTS), (99, None), (None, "x"), (1, "twice"), (1, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "lang": F.lit("en")})
    out = bpe.with_tokens(docs, PATH, decoded=True)
    assert out.columns == ["doc_id", "lang", "n_tokens", "ids", "decoded"]
    own = bpe.WordBpe(PATH)
    monkeypatch.setattr(bpe, "KEPT", kept)
    wanted = sorted((i if i is not None else -1, len(own.encode(t or "")) // 4, own.encode(t or "")) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids)) for r in out.collect()) == wanted
    assert bpe.with_tokens(docs.limit(0), PATH).count() == 0

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from dayloom.llm import pieces

sentencepiece = __import__("sentencepiece")
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model_file())
TABLE = pieces.ChunkTable(PROCESSOR, entries=50)


def both(text):
    parts = [TABLE[w] for w in pieces.marked_words(text)]
    ids = PROCESSOR.encode(text)
    assert pieces.joined_ids(parts).tolist() == ids
    assert pieces.decode_joined(parts) == PROCESSOR.decode(ids)


def test_fixed_cases():
    for t in ("", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "a\n b\t c", "▁", "a▁b", "▁▁x ▁", "日本 語\u3000x", "é ñ ß", "<s> </s> <unk>", "<0x41> x", "a\u00a0b", "\x00 \x01", "🙂 🙃🙂", "x" * 5000, "ab " * 3000):
        both(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é▁\n\t日🙂<>0x41"), max_size=40))
def test_any_text(text):
    both(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_unicode(text):
    both(text)


def test_table(spark):
    rows = [(1, "a b  c", "x"), (2, None, "x"), (3, "", "x"), (4, "a b  c", None), (5, "w " * 20000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {r.doc_id: r for r in pieces.encode_documents(df, pieces.default_model_file(), with_ids=True).collect()}
    for i, t, _ in rows:
        ids = PROCESSOR.encode(t or "")
        assert out[i].n_tokens == len(ids) and out[i].ids == ids and out[i].decoded == PROCESSOR.decode(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(out[i].decoded.encode()).hexdigest()
    assert pieces.encode_documents(df.limit(0), pieces.default_model_file()).collect() == []

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strophe.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files here")

TEXTS = ["", None, "  two  blanks\n\n \tand tabs ", "<|endoftext|> isn't special", "もう一度遠い海へ " * 30, "x" * 700, "a\n\nb  c\r\n  d" * 40, "🎤🎶 é ​", "word " * 200, "12345 6789, don't!"]


@pytest.mark.parametrize("chunk,overlap", [(1, 1), (7, 3), (40, 15), (97, 31), (1_000, 100)])
def test_chunks_give_the_ids_of_the_whole(chunk, overlap):
    enc = tokens.Encoder()
    for t in TEXTS:
        assert enc(t, chunk, overlap) == tokens.encode(t)
        assert tokens.decode(enc(t, chunk, overlap)) == (t or "")


@given(st.text(alphabet="ab '’sd\n\t  1é夜🎤.", max_size=200), st.integers(1, 30), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_any_text_any_chunk(text, chunk, overlap):
    assert tokens.encoder()(text, chunk, overlap) == tokens.encode(text)


@pytest.mark.parametrize("segment,overlap", [(40, 15), (97, 31), (tokens.SEGMENT, tokens.SEGMENT_OVERLAP)])
def test_segments_give_the_ids_of_the_whole(spark, segment, overlap):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(100, TEXTS[4], [1]), (100, TEXTS[4], [1])], "id bigint, text string, ids array<int>")
    rows = tokens.token_ids(df, "id", "text", chunk=30, overlap=10, segment=segment, segment_overlap=overlap).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert list(r.ids) == tokens.encode(TEXTS[4] if r.id == 100 else TEXTS[r.id])
    assert tokens.token_ids(df.limit(0), "id", "text").count() == 0


def test_documents_go_through_the_stitch():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    joined = [tokens.pre_tokens(t)[1] for t in texts]
    assert sum(j > 1 for j in joined) == sum(len(t) > tokens.CHUNK + tokens.OVERLAP for t in texts) > 50
    assert all(tokens.encoder()(t) == tokens.encode(t) for t in texts)


def test_other_library_agrees():
    tk = pytest.importorskip("tokenizers")
    path = tokens.VOCABULARY.replace(".tiktoken", ".json")
    t = tk.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for x in TEXTS:
        if x:
            assert tokens.encode(x) == t.encode(x, add_special_tokens=False).ids

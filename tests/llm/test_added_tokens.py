from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries, tokens

LIBRARY = Tokenizer.from_file(queries.BYTE_BPE)
PART = st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<", " ", "\n", "a", "word.", "\u00e9", "| ", "12"])


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_added_token_in_a_text_is_found():
    texts = ["a text <|endoftext|> more", "", "<|endoftext|>", "plain text.", "x<|endoftext|><|endoftext|>\ny"]
    got = [x.tolist() for x in tokens.encoder(queries.BYTE_BPE).encode(texts)]
    assert got == library(texts) and got[0] == [64, 2420, 220, 50256, 517]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PART, max_size=12).map("".join), min_size=1, max_size=6))
def test_texts_with_added_tokens_give_the_librarys_ids(texts):
    assert [x.tolist() for x in tokens.encoder(queries.BYTE_BPE).encode(texts)] == library(texts)

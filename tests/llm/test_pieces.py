from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries, tokens

TEXT = st.text(alphabet=st.one_of(st.sampled_from("aé '\n\t.,s1　\xa0日"), st.characters(blacklist_categories=("Cs",))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_any_texts_give_the_librarys_ids(texts):
    library = Tokenizer.from_file(queries.BYTE_BPE) if not hasattr(test_any_texts_give_the_librarys_ids, "t") else test_any_texts_give_the_librarys_ids.t
    test_any_texts_give_the_librarys_ids.t = library
    assert [x.tolist() for x in tokens.encoder(queries.BYTE_BPE).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_any_texts_decode_to_themselves(texts):
    coder = bpe.ranks(queries.MULTI_BPE)
    assert [coder.decode(i) for i in coder.encode(texts)] == [t.encode() for t in texts]


def test_code_points_are_classed_as_the_library_does():
    import tiktoken
    import public_tokenizers

    coder = bpe.ranks(queries.MULTI_BPE)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 5 == 0)]
    for i in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b{chr(c)}! {chr(c)}" for c in points[i : i + 20_000]]
        assert [x.tolist() for x in coder.encode(texts)] == reference.encode_ordinary_batch(texts)

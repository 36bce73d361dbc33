import public_tokenizers
from tokenizers import Tokenizer, models

from quire.llm.tokencount import WORD, LongestMatch, token_counts, word_pieces_of_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, vocabulary):
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), 0)
        if not end:
            return 0
        at, n = end, n + 1
    return n


def test_small_vocabulary_by_hand():
    vocabulary = ["a", "abcdx", "##b", "##c", "##cdy", "##dz"]
    machine = LongestMatch(vocabulary)
    for word, n in {"a": 1, "abcdz": 4, "abcdx": 1, "abcdy": 3, "abcd": 0, "b": 0, "abcz": 0, "": 0}.items():
        assert machine.count(word) == n == greedy(word, set(vocabulary)), word


def test_random_words_against_greedy():
    import random
    rng = random.Random(4)
    for _ in range(60):
        vocabulary = {rng.choice(["", "##"]) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))}
        machine = LongestMatch(vocabulary)
        for _ in range(80):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
            assert machine.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_given_texts_against_the_library(spark):
    pieces = dict.fromkeys(["[UNK]", *word_pieces_of_byte_bpe(PATH)])
    model = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=10**6))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        tokens = [model.encode(w).tokens for w in words]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(words), sum(map(len, tokens)))
        assert got[r.doc_id].n_unknown == sum(t == ["[UNK]"] for t in tokens)


def test_awkward_rows(awkward, empty):
    rows = token_counts(awkward, PATH).collect()
    assert len(rows) == awkward.count()
    assert all(r.n_words == r.n_tokens == r.n_unknown == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert len({(r.n_words, r.n_tokens) for r in rows if r.doc_id == 5}) == 1
    assert next(r.n_words for r in rows if r.doc_id == 7) == 60_000
    assert token_counts(empty, PATH).count() == 0

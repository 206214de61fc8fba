from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from millrace.llm import tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return tokens.load(PATH), tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    parts = [*"ab cde  \n'’.,srt1é日<|\t \x85", "'s", "'ll", "  ", "<|endoftext|>", " ", "the ", " and", "ſ", "👩‍👩‍👧"]
    fixed = ["", " ", "a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "it's we'LL", "trail \n", "\x1c x", "-" * 300, "1234 56\t78\r\n", "z" * 3000]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def test_counts(both):
    counter, library = both
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]
    assert counter.counts(texts()) == expected
    assert [counter.count(t) for t in texts()] == expected and counter.count(None) == 0


def test_every_prefix(both):
    counter, library = both
    for t in texts()[:120]:
        if len(t) < 200:
            assert counter.prefix_counts(t).tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_documents(both, documents, odd_documents, no_documents):
    _, library = both
    truth = {r.doc_id: r.text for r in documents.collect()}
    for r in tokens.token_counts(documents, PATH).collect():
        assert r.n_tokens == len(library.encode(truth[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(truth[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)
    rows = tokens.token_counts(odd_documents, PATH).collect()
    assert len(rows) == odd_documents.count() and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (3, 4)} == {(0, 0)}
    assert tokens.token_counts(no_documents, PATH).count() == 0


def test_budgets(both, documents):
    counter, library = both
    row = tokens.prefix_index(documents.limit(1), PATH).first()
    text = documents.where(f"doc_id = {row.doc_id}").first().text
    cut = tokens.longest_within(bytes(row.counts), 50)
    assert len(library.encode(text[:cut], add_special_tokens=False).ids) <= 50
    assert row.n_tokens == counter.count(text)


@pytest.mark.parametrize("budget", [0, 1, 5, 17])
def test_where_budgets_end(both, budget):
    """Against the library's counts of all prefixes."""
    counter, library = both
    more = ["the quick brown fox's 12345 jumps, over; the lazy dog " * 2 + "end", "a " * 30 + "b", "x" * 150, "one\n\n two   three four five six seven eight " * 3]
    for t in texts()[:150] + more:
        if len(t) < 200:
            fits = [len(library.encode(t[:i], add_special_tokens=False).ids) <= budget for i in range(len(t) + 1)]
            assert counter.within(t, budget) == max(i for i, ok in enumerate(fits) if ok), t


def test_cut_documents(both, documents):
    counter, library = both
    truth = {r.doc_id: r.text for r in documents.collect()}
    for r in tokens.token_counts(documents, PATH, 100).collect():
        text, n = truth[r.doc_id], r.chars_within
        count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
        assert count(text[:n]) <= 100 and (n == len(text)) == (r.n_tokens <= 100)
        assert all(count(text[: n + k]) > 100 for k in range(1, min(12, len(text) - n + 1)))


def test_white_space_runs_take_linear_memory(both):
    import time

    counter, library = both
    began = time.process_time()
    table = counter.prefix_counts("a" + " " * 30_000 + "\n" * 2000 + "b<|endoftext|>")
    assert time.process_time() - began < 20 and len(table) == 32_016
    for i in (1, 2, 17, 500, 30_001, 30_050, 32_001, 32_002, 32_005, 32_015):
        text = ("a" + " " * 30_000 + "\n" * 2000 + "b<|endoftext|>")[:i]
        assert table[i] == len(library.encode(text, add_special_tokens=False).ids)

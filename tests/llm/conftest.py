import pytest

pytest.importorskip("sonorant.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, size string, shard int, token string, w string, pii string"


def sentence(k, n=60):
    """n words that depend on k, with a stop word now and then."""
    return " ".join("the" if i % 6 == 0 else f"wort{(k * 7919 + i * 104729) % 5003}x" for i in range(n))


def edge_rows():
    """Nulls in every column, empty, blank and one-word texts, repeated rows, equal and alike texts, a very long text."""
    a = sentence(1, 80)
    near = a.replace("wort", "Wort", 3).rsplit(" ", 2)[0]
    texts = [None, "", " \t\n ", "one", "two words", a, a, near, sentence(2), sentence(3) + " mail x.y@host.example.org or +49 151 1234 5678 now", sentence(4, 6000), "ß" * 3000, "a@" * 500, "1." * 2000 + "1", "token=abcdefgh " + sentence(5)]
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), "x", "y", 1, "z", "w", "p") for k, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, sentence(6), None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

WORDS = "the of Und été ñandú straße %%% | co-op don't 12345 x 漢字 naïve🙂 A1b2".split()


def make_texts(seed=7, n=60):
    rng = random.Random(seed)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "the the the the the the", "a  b\n\nc \n d   e\t\tf", "x\x1cy z w v <|endoftext|> q"]
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(9000))
    texts += [long, "w" * 30000]
    passage = " ".join(f"shared{i}" for i in range(60))
    for i in range(n):
        body = " ".join(rng.choice(WORDS) + ("" if rng.random() < 0.5 else str(rng.randrange(400))) for _ in range(rng.randrange(1, 160)))
        if i % 6 == 0:
            body = body + "\n" + passage + ". " + body[:40]
        if i % 9 == 0:
            body = body + "\n" + body
        texts.append(body)
    texts += texts[12:20]
    base = texts[25].split()
    for i in range(8):
        near = list(base)
        near[rng.randrange(len(near))] = f"changed{i}"
        texts.append(" ".join(near))
    return texts


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text) with nulls, empty and long texts, copies, repeated and null ids."""
    rows = [(i * 3 % 101, t) for i, t in enumerate(make_texts())]
    return rows + [rows[20], rows[20], (None, "a null id here"), (None, None), (5, "clash of ids"), (5, "another clash")]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows as documents, with columns whose names operators use inside."""
    rows = [(i, t, None if k % 7 == 0 else "en", [None, "s1", "s2", "s3"][k % 4], 1, 2, 3, 4, "x", 6) for k, (i, t) in enumerate(messy_rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, f int, start int, size string, score int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def rows_of():
    def rows(df, *columns):
        key = lambda r: tuple((x is not None, x) for x in r)
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)

    return rows


@pytest.fixture(scope="session")
def in_order():
    return lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))

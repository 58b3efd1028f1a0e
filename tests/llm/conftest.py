import random

import pytest

HOT = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3).strip()


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "é", "st", "ou", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): null, blank, long and odd texts, copies, near copies, shared passages, repeated rows, equal and null ids."""
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(12, 160)) for _ in range(24)]
    out = list(enumerate(texts, 10))
    out += [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "a b c d"), (5, "\x0b\x0c x\r\ny "), (None, texts[0]), (None, None), (6, "🙂 naïve café 漢字  double   blanks \n\n end ")]
    out += [(40 + i, texts[i % 3]) for i in range(9)]  # copies
    out += [(60 + i, texts[5] + f" tail{i}") for i in range(4)]  # near copies
    out += [(70 + i, sentence(rng, 30) + "\n" + texts[7] + "\n" + sentence(rng, 20) + texts[7]) for i in range(4)]  # a shared passage, twice each
    out += [(80, "x" * 700), (81, "ab" * 300), (82, HOT), (83, HOT + " " + HOT), (84, "line one two three four five\n" * 6)]
    out += [(90, texts[9]), (90, texts[9]), (90, texts[10] + " " + texts[9])]  # a repeated row, and another of the same id
    out += [(95, "say token=abc123def456 and AKIA" + "Z" * 16 + " é " + "0af" * 9 + ' "api_key" : \'Zz9-long.enough\' token:token:abcdefgh')]
    out += [(96, "so it goes. Released under the MIT License. Bye"), (97, sentence(rng, 3000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with the other columns of documents, and with names that the operators use themselves."""
    clash = "signals block row_key _row_key fp spans _spans kept part place words bucket _stratum _cut_duplicate_lines _good"
    table = [(d, t, ["en", "fr", None][i % 3], f"src{i % 2}", len(t or "")) + tuple(f"{i}" for _ in clash.split()) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash.split())
    return spark.createDataFrame(table, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

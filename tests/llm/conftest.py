from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, signature string, lines int, label string"
LONG = "unterwegs mit dem langen text " * 12_000
BASE = " ".join(f"alpha{i} beta{i * 7 % 40} gamma" for i in range(60))


def odd_rows():
    """NULLs in every column, empty, blank and very long texts, repeated rows, ties."""
    texts = {1: BASE, 2: BASE, 3: BASE.replace("alpha30", "delta30"), 4: "", 5: " \t\n ", 6: None, 7: LONG, 8: "one", 9: "!!! ... ???", 10: "Ünïcode wörter 漢字 😀 \x00 end"}
    rows = [(i, t, "de" if i == 7 else "en", "s", None if t is None else len(t), i, "x", 1, None) for i, t in texts.items()]
    rows.append(rows[0])  # a repeated row
    rows.append((None, BASE, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

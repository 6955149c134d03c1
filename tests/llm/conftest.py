import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, decoded string, kept string, row string, leaks string, `End` string, __gone string, __key string, __lang string, n_lines string, base_failed string, `a.b` string"
LONG = "the and of to in " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a repeated id, and columns with names that clash."""
    rest = tuple(f"v{k}" for k in range(12))
    rows = [
        (None, "no id here but a text", "en", "s", 5, *rest),
        (1, None, "en", "s", None, *rest),
        (2, "", None, None, 0, *(None,) * 12),
        (3, LONG, "en", "s", len(LONG), *rest),
        (4, "same text twice\nsame text twice", "fr", "s", 10, *rest),
        (4, "same text twice\nsame text twice", "fr", "s", 10, *rest),
        (5, "one text", "en", "t", 1, *rest),
        (5, "another text of the same id", "en", "t", 1, *rest),
        (6, " \n\t\n ", "en", "s", 5, *rest),
        (7, "é中文 \U0001f600 \x1c\x1f\x00 ​ end", "en", "s", 5, *rest),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

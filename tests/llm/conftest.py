import random

import pytest
from pyspark.sql import functions as F

# Names that operators use inside; extra columns of the input may have them.
CLASHES = ["key", "row", "w", "tk", "_key", "lang_pred", "h", "at", "paths", "_spans", "spots", "size", "piece", "_r"]


def sentence(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}x" for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows,
    ties and extra columns with clashing names."""
    rnd = random.Random(5)
    base = sentence(rnd, 300)
    near = base.replace(base.split()[150], "changed", 1)
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, near, None), (4, None, "en"), (5, "", "de"),
            (6, " \n\t ", None), (7, "one two", "fr"), (8, "a" * 5000, "en"), (9, sentence(rnd, 20000), "en"),
            (None, sentence(rnd, 120), "de"), (None, None, None), (10, "ÄÖÜ größe naïve 東京 \U0001f600 text", "de"),
            (11, "!!! ... ###", "en"), (12, base[:900] + " " + sentence(rnd, 80), "fr"), (10, "same id, other text", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("1 = 0")

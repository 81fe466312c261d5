import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in that it is was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()
FRENCH = "le la les un une des et est dans pour que qui sur pas plus avec son elle nous vous être avoir faire très bien été même où déjà après français garçon forêt hôtel voilà".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang[, source]]) with clashing extra columns if asked."""

    def table(rows, extra=()):
        full = [(i, t, *((*rest, 'src')[:2] if rest else ('en', 'src'))) for i, t, *rest in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
        for c in extra:
            df = df.withColumn(c, F.lit("x"))
        return df

    return table


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four five"), (5, "one two three four five"), (6, "one two three four five"), (7, "ONE  two\tthree four five"), (8, "é ß 漢字 😀 \0 x"), (9, "a" * 30_000), (10, "b " * 30_000)]
CLASHES = ("h", "row", "sig", "n", "word", "score", "place", "chunk", "gone", "id", "start", "length", "media", "lang_pred", "_range", "held_out", "p", "key")

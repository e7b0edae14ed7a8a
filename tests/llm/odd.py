"""Tables of odd rows that every operator must survive."""

from pyspark.sql import DataFrame, SparkSession

LONG = "la casa que del los " * 20_000
TEXTS = [
    (1, "The cat sat on the mat, and the dog was with it.", "en", "a"),
    (2, "The cat sat on the mat, and the dog was with it.", "en", "a"),
    (2, "The cat sat on the mat, and the dog was with it.", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\n ", "fr", None),
    (None, "un chat est sur la table avec les chiens", "fr", "b"),
    (6, LONG, "es", "b"),
    (7, "1234 5678 !!! ###", None, None),
    (8, "el perro y la casa de los amigos", "es", None),
    (9, "Здравствуй мир 你好", None, "c"),
    (10, "<|endoftext|> it's é́   A B \x1c can't ﬁx İ ΑΣ x" + "y" * 5000, "en", "c"),
]


def documents(spark: SparkSession, empty: bool = False) -> DataFrame:
    """``id, body`` with other columns whose names operators use themselves."""
    rows = [] if empty else [(i, t, lang, source, "x", 1, "k", 2) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, "id long, body string, lang string, source string, text string, start long, place string, fp long")


def vectors(spark: SparkSession, empty: bool = False) -> DataFrame:
    rows = [
        (0, [1.0, 0.5, 0.0]), (1, [1.0, 0.5, 0.0]), (100, [1.0, 0.5, 0.0]), (2, [-1.0, 2.0, 3.0]), (2, [-1.0, 2.0, 3.0]), (3, None), (4, [0.0, 0.0, 0.0]),
        (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, []), (200, [0.3, 0.3, 0.3]), (300, [0.0, 0.0, 0.0]),
        (200, [0.3, 0.3, 0.3]), (None, [1.0, 1.0, 1.0]), (9, [1.0, 2.0]), (400, [2.0, 1.0]), (10, [5.0, -5.0, 0.25]),
    ]
    return spark.createDataFrame([] if empty else [(i, v, 0.0, 1) for i, v in rows], "id long, e array<float>, score double, cell long")

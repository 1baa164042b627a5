"""Documents with nulls, empty and long texts, copies, ties and clashing columns, and helpers to make frames of them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("block", "bucket", "size", "place", "pos", "n", "path", "share", "edges", "rank", "length", "score", "known")


def words(seed: int, number: int, vocabulary: int = 400) -> str:
    source = random.Random(seed)
    return " ".join(f"w{source.randrange(vocabulary)}é" if source.random() < 0.1 else f"w{source.randrange(vocabulary)}" for _ in range(number))


def rows() -> list[tuple]:
    shared, other = words(1, 80), words(2, 55)
    texts = [
        words(3, 120), words(3, 120), f"{words(4, 30)} {shared}  {words(5, 30)}", f"{words(6, 10)}\n{shared}\t{words(7, 90)}",
        f"{shared} {other}", f"{other} {shared}", None, "", " \n\t ", "one", "One", "again " * 300, "again " * 120, words(3, 119) + " changed",
        f"{words(8, 3000)} {shared} {words(9, 3000)}", words(10, 49), words(10, 50), words(10, 50), f"x {words(10, 50)}", "a b",
        f"{other}. {words(11, 20)}", f"{words(12, 20)} {other}",
    ]
    found = [(10 * at, text, "en" if at % 3 else "de", f"s{at % 4}" if at % 5 else None, None) for at, text in enumerate(texts)]
    return [*found, found[2], (None, texts[2], "en", "s0", 3), (None, None, None, None, None)]


def frame(spark, given=None):
    """Rows as a frame with further columns whose names the operators use inside."""
    made = spark.createDataFrame(rows() if given is None else given, SCHEMA)
    for name in CLASHES:
        made = made.selectExpr("*", f"'clash' as `{name}`")
    return made


def of(found) -> list[tuple]:
    return sorted((tuple(row) for row in found.collect()), key=repr)


def plain_bytes(text) -> bytes:
    return (text or "").encode()

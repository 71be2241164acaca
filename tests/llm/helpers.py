"""Tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, bucket int, key bigint"

LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(9000))
BASE = " ".join(f"w{i} x{i * 7 % 50}" for i in range(60))


def odd_rows():
    texts = {
        1: BASE, 2: BASE, 3: BASE.replace("w30", "other"), 4: None, 5: "", 6: "  \n ", 7: "one", 8: "one two", 9: LONG, 10: LONG + " tail",
        11: "a\x1cb  c\t\n\nd é 日本語 😀 <|endoftext|> </s> 'S don't", 12: "no spaces" + "x" * 3000, 13: "Line one.\n\n\nLine two.\n" * 20, 14: BASE[:100],
    }
    rows = [(i, t, "en", "src0", None, 1.0, 5, 6, 7) for i, t in texts.items()]
    rows += [rows[0], (None, BASE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (-3, BASE + " z", None, "s", 1, 0.5, 1, 1, 1)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random

#: Null, empty, blank, repeated, very long, and strange texts.
ODD = [None, "", " ", "\n\n", "a", "a b", "a b c d", "a b c d", "Σ ΑΣ İ ß é é", "x" * 5000, "the " * 3000, "<|endoftext|> and <|startoftext|>x <s> </s>", "  two  blanks \n b ", "tab\t b\x1cc\x85d\xa0e f", "日本語 テキスト 😀👩‍👩", "▁▁x ▁", "\x00\x01", "isn't WE'LL 123 4½"]


def noise(n: int, seed: int = 1, size: int = 40) -> list[str]:
    r = random.Random(seed)
    letters = [*"abcXYZ  \n\t.,!'0123<|>", "ß", "Σ", "É", "é", "İ", " ", "\x1c", "\x85", "日", "😀", "<|endoftext|>", "<s>", "▁", "'s", "the ", "ing", "\r\n"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, size))) for _ in range(n)]


def table(spark, texts, extra=True):
    """documents with null texts, a row repeated, and extra columns whose names clash with results."""
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, component_id string").repartition(3)

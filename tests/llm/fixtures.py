"""Small rows with every awkward case: nulls, empty and long texts, repeats, other columns of the same name."""

TEXTS = [
    "The quick brown fox, it's  jumping over the lazy dog 12345!!",
    "",
    None,
    "   \n\t ",
    "Élan naïve — café ☕ 日本語テキスト   x y é İSTANBUL ΣΑΣ",
    "<|endoftext|> a<|startoftext|>b <unk> <0x41> </s>",
    "The quick brown fox, it's  jumping over the lazy dog 12345!!",
    "a" * 5000,
    "word  " * 30000,
    "don't 'll we're\r\nline\x0bvt\x0cff \x1c\x85 end",
    "\U0001f600\U0001f468‍\U0001f469 zero\x00byte",
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en", 1.5, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids double, shard string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, ids double, shard string")

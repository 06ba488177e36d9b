"""Rows that every operator must stand."""

# Columns that operators use themselves, as columns of somebody's table.
CLASHING = {
    name: "long"
    for name in (
        "number row score print list u v node root label hash new kind canon at size gram item span words n_tokens "
        "ids decoded start base total tail component_id fingerprint lang_pred entity_kinds entities kept"
    ).split()
}
LONG = "Lang und breit, the long of it. " * 8000
TEXTS = [
    (1, "The first of many words, and then some more of them.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "de", None, 4),
    (5, LONG, "de", "b", len(LONG)),
    (6, "Same text here, twice and twice.", "en", "b", 3),
    (7, "Same text here, twice and twice.", "en", "b", 3),
    (8, "Same text here, twice and twice.", "en", "b", 3),
    (8, "Same text here, twice and twice.", "en", "b", 3),
    (None, "No id: Ünïcödé ▁ 日本 😀 \x00 <s> <|endoftext|>", "fr", "c", 9),
    (None, None, None, None, None),
    (-4, "!!! 123 ...", None, "c", 11),
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=TEXTS, clashing=False):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    if clashing:
        docs = docs.selectExpr("*", *[f"{k} AS `{name}`" for k, name in enumerate(CLASHING)])
    return docs


def folder(tmp_path, **tables):
    for name, table in tables.items():
        table.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"

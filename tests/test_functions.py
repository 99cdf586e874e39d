import math

from pyspark.sql import functions as F

from marlstone.functions import color, hashing, text, vectors


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(expr.alias("v")).first()["v"]


def test_fold_and_tokens(spark):
    assert one(spark, text.fold(F.col("a")), a="ÁÇñ Straße É") == "acn strasse e"
    assert one(spark, text.tokens(F.col("a")), a="C++ and node.js, r model. A") == ["c++", "and", "node.js", "model."]
    assert one(spark, text.tokens(F.col("a")), a=None) == []
    assert one(spark, text.search_text(F.col("a")), a="  Niño\n  x ") == "nino x"


def test_cleaning(spark):
    assert one(spark, text.clean_string(F.col("a")), a="  \t ") is None
    assert one(spark, text.clean_list(F.col("a")), a=[" Python", "python", "", None, "SQL "]) == ["Python", "SQL"]
    assert one(spark, text.norm_key(F.col("a")), a="  Héllo -- World!! ") == "hello world"
    assert one(spark, text.slug(F.col("a")), a="Éa b") == "a-b"
    assert one(spark, text.slug(F.col("a")), a="--") == "section"


def test_urls(spark):
    u = lambda s: one(spark, text.canonical_url(F.col("a")), a=s)
    assert u("[x](HTTPS://A.b)") is None
    assert u("[x](https://Jobs.Example.com/a/?utm_source=x&id=7&ref=z#frag)") == "https://jobs.example.com/a?id=7"
    assert u("https://e.com") == "https://e.com/"
    assert u("https://e.com/?a=&b=1+2") == "https://e.com/?a=&b=1+2"
    assert u("none") is None


def test_work_model_and_dates(spark):
    assert one(spark, text.work_model(F.col("a")), a="Híbrido") == "Hybrid"
    assert one(spark, text.work_model(F.col("a")), a=" flexible ") == "flexible"
    assert one(spark, text.posted_date(F.col("a")), a="2026-99-99")["iso"] == "2026-99-99"
    assert one(spark, text.posted_date(F.col("a")), a="yesterday")["iso"] is None


def test_fields_and_paths(spark):
    body = "- **Level:** `Core`\n - **level:** working \nother\n- **A b:** x: y"
    assert one(spark, text.fields(F.col("a")), a=body) == {"level": "working", "a b": "x: y"}
    assert one(spark, text.posix_join(F.lit("a/b"), F.col("a")), a="../c/./d.md") == "a/c/d.md"
    assert one(spark, text.posix_join(F.lit(""), F.col("a")), a="../x.md") == "../x.md"
    assert one(spark, text.numbers(F.col("a")), a="3,5 and 12%") == ["3.5", "12"]


def test_plain_number(spark):
    for v in (91.0, 88.5, 0.0, 100.0, 57.05, 33.333333333):
        assert spark.range(1).select(text.plain_number(F.lit(v)).alias("v")).first()["v"] == f"{v:g}"


def test_identity(spark):
    a = spark.range(1).select(hashing.stable_identity(F.lit("ACME"), F.lit("Lead"), F.lit("México"), F.lit("u")).alias("v")).first()["v"]
    b = spark.range(1).select(hashing.stable_identity(F.lit("acme "), F.lit("lead"), F.lit("Mexico"), F.lit(None).cast("string")).alias("v")).first()["v"]
    c = spark.range(1).select(hashing.stable_identity(F.lit("acme"), F.lit("lead"), F.lit(None).cast("string"), F.lit("u")).alias("v")).first()["v"]
    assert a == b and a != c and a["entity_id"] == "vac-" + a["identity_key"][:16]


def test_vectors(spark):
    cos = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("v")).first()["v"]
    assert cos([1.0, 0.0], [1.0, 0.0]) == 1.0
    assert cos([], []) == 0.0 and cos([0.0], [1.0]) == 0.0 and cos([1.0, 2.0], [1.0]) == 0.0
    assert math.isclose(cos([1.0, 1.0], [1.0, 0.0]), 2**-0.5)


def test_contrast(spark):
    assert round(one(spark, color.contrast(F.lit("#000000"), F.lit("#ffffff"))), 2) == 21.0


def test_fold_equals_full_decomposition_on_all_code_points(spark):
    """Each code point alone and within a text, against the standard library."""
    import unicodedata

    def brute(s):
        return "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)).casefold()

    rows = [(chr(cp), "Aé" + chr(cp) + "ß…Σ") for cp in range(1, 0x110000) if not 0xD800 <= cp < 0xE000 and unicodedata.category(chr(cp)) not in ("Cn", "Co")]
    rows += [("", None), ("각éﬃ" * 3000, "ΑΣ Σας ﷺ")]
    df = spark.createDataFrame(rows, "a string, b string").repartition(8)
    wrong = [(r["a"], r["fa"]) for r in df.select("a", "b", text.fold(F.col("a")).alias("fa"), text.fold(F.col("b")).alias("fb")).toLocalIterator() if r["fa"] != brute(r["a"]) or r["fb"] != (None if r["b"] is None else brute(r["b"]))]
    assert not wrong, wrong[:20]

import pytest

#: Nulls in every column, empty and long texts, ties, repeated rows.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "src0", 60),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "src0", 60),
    (2, "The quick brown fox jumps over the lazy dog again and again.", None, "src1", None),
    (3, None, "en", None, None),
    (4, "", "fr", "src0", 0),
    (None, "Write to jane.doe@mail.example.com or +1 (234) 555-1234 now, 10.0.0.1 said 😀.", "en", "src2", 70),
    (5, "été à la plage, ça va? " * 400, "fr", "src2", 9000),
    (6, "x" * 50_000, "de", "src3", 50_000),
    (7, "  \n\t \x1c tabs\tand odd  spaces \n\n", "es", "src0", 20),
    (7, "another text under the same id", "es", "src0", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, key string, base string"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder with tables of hard cases and columns whose names clash with inner ones."""
    d = str(tmp_path_factory.mktemp("edge"))
    rows = [(*r, "s", "n", "k", "b") for r in TEXTS]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (4, None, 1), (None, 1, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    conversations = [
        (1, 0, "user", "hi", 1), (1, 1, "assistant", "hello", 1), (2, 0, "user", "hi", 1), (2, 1, "assistant", "hello", 1), (2, 2, "user", "bye", 1),
        (3, 5, " User", "hi", 2), (3, 9, "assistant", "hello", 2), (3, 900, "user", "bye", 2), (4, 0, None, None, 0), (4, 0, None, None, 0), (None, None, "user", "<|im_end|>", 3),
        (5, 0, "user", "hi", 1), (5, 0, "user", "also", 1),
    ]
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string, block int").write.parquet(f"{d}/conversations.parquet")
    vectors = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 2), (4, [0.0, 1.0], None), (5, None, 3), (6, [0.0, 0.0], 3), (7, [float("nan"), 1.0], 3), (8, [None, 1.0], 3),
        (None, [0.0, 1.0], 3), (9, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1e300, 1e300], 1), (11, [], 1),
    ]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    pages = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>just &amp; text &lt", "x"), (3, "u", "<script>if (a</p>", "x"), (3, "u", "no tags at all " * 20, "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, edge, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "conversations", "embeddings", "pages"):
        spark.read.parquet(f"{edge}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d

import pytest

SF = "/root/testdata/sf0.001"

ODD = [
    (None, None, None, None),
    (1, None, "en", "src0"),
    (2, "", "en", "src0"),
    (3, " \t\n\x0b\x0c\r ", "en", None),
    (4, "one", "en", "src1"),
    (5, "It's don't 'tis I'LL we'll  two  spaces\n\n three\n", "en", "src1"),
    (6, "It's don't 'tis I'LL we'll  two  spaces\n\n three\n", "en", "src1"),
    (6, "It's don't 'tis I'LL we'll  two  spaces\n\n three\n", "en", "src1"),
    (7, "café   nbsp   em 　 wide \u0085 nel \x1c fs 1234567 ٣٤ 😀 你好".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "src2"),
    (8, "#$%& | <> *** 12 34", "de", "src2"),
    (9, "same words again " * 400, "en", "src3"),
    (10, "x" * 5000, "en", "src3"),
    (11, "BM RIFF %PDF-1.4 GIF89a \x00 PK\x03\x04 end", "en", "src3"),
    (12, "a\nb\n\n a \nB\nc d\nA", "en", "src3"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

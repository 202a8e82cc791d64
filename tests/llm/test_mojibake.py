import pytest
from pyspark.sql import functions as F

from epiquery.llm import mojibake as M

TEXT = "Les éleveurs de Pâdogo ont déjà noté «12 décès» – l’été à Zibèmi, señor Über Ärztin não três ação ©"
RUSSIAN = "Медсёстры из района подтверждают вспышку, сообщает управление здравоохранения"
VIET = "Người dân vẫn đang điều tra một ổ dịch gồm nhiều người bệnh"


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", [TEXT, RUSSIAN, VIET])
def test_round_trip_from_utf8(text, wrong):
    bad = text.encode("utf-8").decode(wrong, errors="replace") if wrong != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode("utf-8"))
    assert M.is_garbled(bad)
    if "�" not in bad and "\xa0" not in bad:
        good = [a == b for a, b in zip(M.repair(bad).split(), text.split())]
        assert sum(good) >= 0.8 * len(good), M.repair(bad)


@pytest.mark.parametrize("true, wrong", [("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("cp866", "cp1251")])
def test_russian_single_bytes(true, wrong):
    bad = RUSSIAN.encode(true).decode(wrong, "replace")
    assert M.is_garbled(bad) and "вспышку," in M.repair(bad)


def test_twice_and_escaped():
    twice = "Verdachtsfälle".encode().decode("cp1252").encode().decode("cp1252")
    assert M.restored(twice) == (True, "Verdachtsfälle")
    assert M.restored("Verdachtsf&Atilde;&curren;lle") == (True, "Verdachtsfälle")
    assert M.restored("Verdachtsf\\u00c3\\u00a4lle") == (True, "Verdachtsfälle")


@pytest.mark.parametrize("text", [TEXT, RUSSIAN, VIET, RUSSIAN.upper(), "NÃO SÃO ATENÇÃO: À l’hôpital", "ВНИМАНИЕ ВРАЧ", "39°C „Tagen“, 20 km²?", "", "plain", "&eacute;t&eacute; &#1086;&#1090;", "what? really?x=1"])
def test_sound_text_is_left_alone(text):
    assert not M.is_garbled(text) and M.repair(text) == text


def test_lost_characters():
    assert all(M.is_garbled(t) for t in ("Vimel�", "observaci�n", "a�o", "Bren?si", "\\ufffd\\ufffd", "â\x80¦"))


def test_rows(spark):
    long = "word " * 200_000 + "Â© end"
    data = [(1, "Ã©tÃ©"), (1, "Ã©tÃ©"), (2, None), (3, ""), (4, "été"), (None, "Ã©tÃ©"), (5, long)]
    df = spark.createDataFrame(data, "i bigint, t string").withColumn("id", F.lit("clash")).withColumn("text", F.lit("Ã©"))
    assert sorted(r.id for r in M.garbled_rows(df, F.col("i"), F.col("t")).collect()) == [1, 5]
    got = M.repaired_rows(df, F.col("i"), F.col("t")).where("id = 5").first()
    assert got.text == "word " * 200_000 + "© end" and got.n_garbled == 1
    assert M.garbled_rows(df.where("false"), F.col("i"), F.col("t")).count() == 0


@pytest.mark.parametrize("piece", ["x", "&", "Ð¿Ñ€", "a?b", "\\u00"])
def test_time_is_linear_in_a_text_without_blanks(piece):
    import time

    def took(n):
        began = time.perf_counter()
        M.is_garbled(piece * (n // len(piece)))
        return time.perf_counter() - began

    took(10_000)
    assert took(5_000_000) < 12 * max(took(1_250_000), 0.05)


def test_long_words_are_searched_in_pieces():
    word = "é" * 3 + "x" * 5000 + "Ã©tÃ©" + "y" * 5000
    assert M.repair(word) == "é" * 3 + "x" * 5000 + "été" + "y" * 5000


def test_searches_given_up_are_counted(spark, monkeypatch):
    monkeypatch.setattr(M, "MORE_POPS", 1)
    assert M.search("Verdachtsf\u00c3\u0192\u00c2\u00a4lle", 1)[3] is False and M.search("Verdachtsf\u00c3\u0192\u00c2\u00a4lle")[0] == "Verdachtsfälle"


def test_restored_words_equal_the_planted_ones(spark):
    """Words of stored contents, garbled by five wrong decodings: nine of ten come back as they were."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/corpus_item.parquet").where("private.cleancontent.content is not null").selectExpr("private.cleancontent.content").collect()]
    words = sorted({w for t in texts for w in t.split() if not w.isascii() and not M.restored(w)[0]})
    right = total = 0
    for wrong in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437"):
        for w in words:
            try:
                bad = w.encode().decode(wrong)
            except UnicodeDecodeError:
                continue
            if not set(" \t\r\n\x0b\x0c\x85\xa0<>") & set(bad):
                total += 1
                right += M.restored(bad)[1] == w
    assert total > 1000 and right >= 0.9 * total, (right, total)

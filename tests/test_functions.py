import hashlib

import pytest
from pyspark.sql import functions as F

from sedge.functions import ids, text
from sedge.functions import scalars as sc
from sedge.functions.blake3 import blake3
from sedge.functions.segmenter import split


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a  b\t c ", "a b c"),
        ("charak-\nter", "charakter"),
        ("a\fb", "ab"),
        ("x\n 12 / 30 \ny", "x y"),
        ("a\n1\n2\nb", "a 2 b"),
        ("zdanieŻóły", "zdanie Żóły"),
        ("ﬁne", "fine"),
        ("a b", "a b"),
    ],
)
def test_cleanup(spark, raw, clean):
    assert one(spark, text.cleanup(F.col("t")), t=raw) == clean


def test_counters(spark):
    t = "Art. 5 ust. 2 § 1 Dz. U. z 2004 r."
    assert one(spark, text.count_tokens(F.col("t")), t=t) == 11
    assert one(spark, text.count_digits(F.col("t")), t=t) == 7
    assert one(spark, text.count_statutes(F.col("t")), t=t) == 4


@pytest.mark.parametrize(("t", "noise"), [("12 - 3,4:5;_", True), ("...", False), ("1a", False), ("", False)])
def test_numeric_noise(spark, t, noise):
    assert one(spark, text.is_numeric_noise(F.col("t")), t=t) is noise


def test_scalars(spark):
    assert one(spark, sc.expand_csv(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert one(spark, sc.blank_to_null(F.lit("  "))) is None
    assert one(spark, sc.nth_int(F.lit("x, 1, y, 7"), 2)) == 7
    assert one(spark, sc.nth_int(F.lit("1"), 2)) is None
    assert one(spark, sc.last_segment(F.lit("http://h/a/b//"))) == "b"
    assert one(spark, sc.date_path("p", F.lit("2020-01-09"), F.lit("x"), "pdf")) == "p/2020/1/9/x.pdf"
    assert [one(spark, sc.human_size(F.lit(n))) for n in (1023, 1536, 3 << 30)] == ["1023 B", "1.50 KiB", "3.00 GiB"]
    assert one(spark, sc.format_ms(F.lit(1_700_000_000_999))) == "2023-11-14 22:13:20 UTC"
    assert one(spark, sc.display_name(F.lit("a b/c"))) == "structured-a-b-c"
    assert one(spark, sc.display_name(F.lit(""))) == "structured-job"
    assert one(spark, sc.provider_state(F.lit("expired"))) == "Failed"
    assert one(spark, sc.provider_state(F.lit(None).cast("string"))) == "Pending"
    assert one(spark, sc.upper_median(F.array(F.lit(3.0), F.lit(1.0), F.lit(float("nan")), F.lit(2.0), F.lit(9.0)))) == 3.0
    assert one(spark, sc.upper_median(F.array().cast("array<double>"))) is None
    assert one(spark, sc.finite(F.lit(float("inf")))) is None
    assert one(spark, sc.mime_type(F.lit("X.JPG"))) == "image/jpeg"
    assert one(spark, sc.resize_edge(F.lit(10), F.lit(4000), 100)) == 1


def test_backoff(spark):
    got = [one(spark, sc.backoff_ms(F.lit(n), 1000, 60_000)) for n in (0, 1, 5, 6, 40)]
    assert got == [1000, 2000, 32_000, 60_000, 60_000]
    jittered = one(spark, sc.backoff_ms(F.lit(3), 1000, 60_000, jitter=F.lit(0.9)))
    assert jittered == 7200


def test_ids(spark):
    assert one(spark, ids.content_id(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()
    assert one(spark, ids.normalize_cids(F.array(F.lit(" AB "), F.lit("ab"), F.lit("xyz"), F.lit("01")))) == ["ab", "01"]
    assert [one(spark, ids.is_cid(F.lit(c))) for c in ("ab", "a", "AB", "")] == [True, False, False, False]
    assert one(spark, ids.blob_key(F.lit("s"), F.lit("abcd"), "r/")) == "r/blobs/s/ab/abcd"
    assert one(spark, ids.chunk_record_id(F.lit("s"), F.lit("d"), F.lit(3))) == "s-d-chunk-3"


def test_blake3_published_vectors(spark):
    assert blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    long = bytes(i % 251 for i in range(5000))
    assert len({blake3(long), blake3(long[:-1]), blake3(long[:4096])}) == 3
    assert one(spark, ids.blake3_id(F.lit(b"abc"))) == blake3(b"abc")


@pytest.mark.parametrize(
    ("t", "expected"),
    [
        ("Orzeka: 1. jeden 2. dwa 3) trzy 4 ) cztery. A. alfa B. beta.", ["Orzeka:", "1. jeden", "2. dwa", "3) trzy", "4 ) cztery.", "A. alfa", "B. beta."]),
        ("Zgodnie z art. 5 ust. 2 pkt. 1 ustawy. Izba oddala odwołanie.", ["Zgodnie z art. 5 ust. 2 pkt. 1 ustawy.", "Izba oddala odwołanie."]),
        ("Ustawa (Dz. U. z 2004 r. Nr 19, poz. 177, z późn. zm.) obowiązuje.", ["Ustawa (Dz. U. z 2004 r. Nr 19, poz. 177, z późn. zm.) obowiązuje."]),
        ("Czy tak? Nie! Owszem.", ["Czy tak?", "Nie!", "Owszem."]),
        ("Cena 3.50 zł wzrosła.", ["Cena 3.50 zł wzrosła."]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(t, expected):
    assert split(t) == expected


def test_sentences_of_a_batch(spark):
    """As many texts as Spark hands over at once: the same sentences, without all of them as Python objects."""
    import tracemalloc

    import pyarrow as pa

    some = ["Czy tak? Nie! Owszem.", None, "", "Jeden. Dwa ż. " * 20, "   "]
    texts = [*some, None, *["To jest zdanie. Wyszedł." * 10] * 2000, *some]
    tracemalloc.start()
    got = text.sentences.func(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
    want = [None if t is None else [{"ord": i, "text": s} for i, s in enumerate(split(t))] for t in texts]
    assert got.to_pylist() == want
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t string").select("i", text.sentences(F.col("t")).alias("s")).orderBy("i").collect()
    assert [None if r.s is None else [x.asDict() for x in r.s] for r in rows] == want[:5]


def test_sentences_extra_abbreviation():
    assert len(split("Patrz Zał. Nr jeden.")) == 2
    assert len(split("Patrz Zał. Nr jeden.", ("zał.",))) == 1


def test_segmenter_options():
    assert split("Pan J. Nowak przyszedł. Wyszedł.") == ["Pan J. Nowak przyszedł.", "Wyszedł."]
    assert split("Punkt x. Następnie koniec.") == ["Punkt x. Następnie koniec."]  # a Roman ten
    assert split("To y. Następnie koniec.") == ["To y.", "Następnie koniec."]
    assert split("To Ż. Następnie koniec.") == ["To Ż.", "Następnie koniec."]
    assert split("Pan J. Nowak.", abbreviations=False) == ["Pan J.", "Nowak."]
    assert split("Rok 5. Maj.", ordinals=False) == ["Rok 5.", "Maj."] and split("Rok 5. Maj.") == ["Rok 5. Maj."]
    assert split("Zob. skr. Abc.", extra=("skr.",)) == ["Zob. skr. Abc."]


def test_client_ip_and_url(spark):
    def said(mode, xff=None, forwarded=None, peer="10.0.0.1"):
        df = spark.createDataFrame([(peer, xff, forwarded)], "p string, x string, f string")
        return df.select(sc.client_ip(F.col("p"), F.col("x"), F.col("f"), ["10.0.0.1"], mode)).first()[0]

    assert said("off", "1.2.3.4") == "10.0.0.1" and said("x-forwarded-for", " 1.2.3.4 , 5.6.7.8") == "1.2.3.4"
    assert said("x-forwarded-for", "1.2.3.4", peer="9.9.9.9") == "9.9.9.9" and said("x-forwarded-for", "nobody, 1.2.3.4") == "10.0.0.1"
    assert said("forwarded", forwarded='by=1.1.1.1;for=_x, for="2001:db8::1"') == "2001:db8::1" and said("forwarded") == "10.0.0.1"
    for bad in ("1.2.3", "1.2.3.256", "1::2::3", "12345::", "1:2:3:4:5:6:7", ":1:2:3:4:5:6:7:8"):
        assert said("x-forwarded-for", bad) == "10.0.0.1"
    for good in ("::", "::1", "1:2:3:4:5:6:7:8", "fe80::1"):
        assert said("x-forwarded-for", good) == good
    urls = spark.createDataFrame([("a", "uzp"), ("a", "saos"), ("own", "saos")], "u string, s string")
    assert [r[0] for r in urls.select(sc.source_url(F.col("u"), F.col("s"), "a", "saos", "b")).collect()] == ["a", "b", "own"]

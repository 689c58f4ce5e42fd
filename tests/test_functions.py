import pytest
from pyspark.sql import functions as F

from webloom.functions import contact as C
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.urls import canonical_form
from webloom.operators.extract import header_directives


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("HTTPS://Ex.com:443/A/?b=2&a=1#x", None, "https://ex.com/A/?a=1&b=2"),
        ("/p?utm_source=q&UTM_Medium=z&k=", "http://u:p@ex.com:8080/d/", "http://ex.com:8080/p?k="),
        ("http://ex.com", None, "http://ex.com/"),
        ("mailto:a@b.c", "http://ex.com", None),
        ("http://[abc/x", None, None),
        ("http://a:99999/", None, None),
        ("http://[::1]/p", None, "http://[::1]/p"),
        ("", None, None),
        (None, "http://ex.com", None),
    ],
)
def test_canonical_form(raw, base, want):
    assert canonical_form(raw, base) == want


def test_hosts_and_keys(spark):
    urls = ["http://www.Ex.com/a", "ex.com.evil.com", "mailto:a@ex.com", "https://ex.com"]
    assert col(spark, urls, U.host_of) == ["ex.com", "ex.com.evil.com", "", "ex.com"]
    assert col(spark, urls, lambda c: U.is_same_domain(c, F.lit("https://ex.com/"))) == [True, False, False, True]
    assert col(spark, ["https://www.ex.com/", "http://ex.com/a//?q=1", "http://ex.com//"], U.dedup_key) == ["ex.com/", "ex.com/a?q=1", "ex.com"]
    assert col(spark, ["http://e.com/Terms-of-service/x", "http://e.com/legality"], U.is_legal_document) == [True, False]
    assert col(spark, ["http://e.com/a/", "/"], U.link_key) == ["http://e.com/a", "/"]


def test_phones(spark):
    good = ["415-555-0123", "(415) 555-0123", "+1 415 555 0123", "415.555.0123", "4155550123", "+1 (415) 555-0123"]
    assert set(col(spark, good, C.normalize_phone)) == {"4155550123"}
    assert set(col(spark, ["", "12345", "2026", "$1,299.00", "1" * 20, "words", None], C.normalize_phone)) == {""}
    shapes = ["415-555-0123", "2001-2026", "2026-01-15", "1 1 2 3 5 8 13", "+919876543210", "1234567890"]
    assert col(spark, shapes, C.is_phone_shaped) == [True, False, False, False, True, False]
    assert col(spark, ["call (415) 555-0123 now"], C.phones) == [["415) 555-0123"]]


def test_addresses_and_names(spark):
    assert col(spark, ["77 NW Pine St.", "St Louis Avenue", "9 Main Rd, Ste 300"], C.normalize_address) == ["77 northwest pine street", "st louis avenue", "9 main road suite 300"]
    assert col(spark, ["Zabar’s Inc.", "Acme, LLC"], C.normalize_name) == ["zabars inc", "acme llc"]
    assert col(spark, ["acme inc", "acme co ltd", "inc"], C.strip_legal_suffix) == ["acme", "acme", ""]
    assert col(spark, ["9 main road suite 300", "9 main road lisbon", "9 main road"], lambda c: C.address_subsumes(c, F.lit("9 main road"))) == [False, True, False]
    assert col(spark, ["2026 Terms of service Close", "12 Oak Street"], C.addresses) == [[], ["12 Oak Street"]]
    assert col(spark, ["© 2026 Harbor Bikes", "© 2026 All Rights Reserved"], C.copyright_names) == [["Harbor Bikes"], []]


def test_house_numbers_like_years(spark, tmp_path):
    from webloom.plans.built import contact_functions

    assert col(spark, ["2026 Terms of service Close, 1900 N. Elm Ave"], lambda c: C.addresses(c, years=True)) == [["2026 Terms of service Close", "1900 N. Elm Ave"]]
    spark.createDataFrame([(1889,), (1890,), (2089,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    assert {r.k: r.found for r in contact_functions(spark, str(tmp_path)).collect()} == {1889: "1899 St Mary Rd", 1890: "1900 N. Elm Ave", 2089: "2099 SW Oak Blvd"}


def test_text(spark):
    assert col(spark, [" a\x1c b \n"], T.normalize_whitespace) == ["a b"]
    assert col(spark, ["The repairing of bicycle wheels, für class"], T.tokenize) == [["repairing", "bicycle", "wheel", "f", "r", "class"]]
    assert col(spark, ["x" * 201], T.quote) == ['"' + "x" * 200 + '..."']
    q = T.tokenize(F.lit("repairing bicycle wheels"))
    assert col(spark, ["We repair bicycle wheels daily"], lambda c: T.coverage(q, T.tokenize(c))) == [pytest.approx(2 / 3)]
    assert col(spark, ["a"], lambda c: T.coverage(T.tokenize(F.lit("the of")), T.tokenize(c))) == [0.0]


def test_header_directives(spark):
    assert col(spark, ["googlebot: noindex, NoFollow"], lambda c: header_directives(F.array(c, F.lit("noindex")))) == [["noindex", "nofollow"]]

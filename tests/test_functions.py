"""Scalar operators: golden cases and their negatives."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelark.functions import attachments as A
from sievelark.functions import defang as D
from sievelark.functions import hosts as HO
from sievelark.functions import html as H
from sievelark.functions import links as L
from sievelark.functions import names as N
from sievelark.functions import suffixes as S


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(use(F.col("x"))).first()[0]


@pytest.mark.parametrize(("use", "value", "want"), [
    (D.defang_url, "https://a.example/b.c?d=1", "hxxps://a[.]example/b[.]c?d=1"),
    (D.defang_url, "HTTP://A.example", "hxxp://A[.]example"),
    (D.defang_url, "java\tscript:alert(1)", "javascript[:]alert(1)"),
    (D.defang_url, "file://host/x", "file[:]//host/x"),
    (D.defang_email, "a@b.example", "a[at]b[.]example"),
    (D.defang_ipv6, "2001:db8::1", "2001[:]db8[:][:]1"),
    (D.defang_text, "see https://x.example/a, mail a.b@c.example or 1.2.3.4; v1.2.3.4.5 stays.", "see hxxps://x[.]example/a, mail a[.]b[at]c[.]example or 1[.]2[.]3[.]4; v1.2.3.4.5 stays."),
    (D.defang_text, "plain words. no tokens", "plain words. no tokens"),
    (D.refang, "hxxps://a[.]b(.)c/[at]", "https://a.b.c/@"),
    (D.clean, "a\x00b\tc\x9bd", "ab\tcd"),
])
def test_defang(spark, use, value, want):
    assert one(spark, value, use) == want


def test_defang_is_idempotent_and_null_safe(spark):
    rows = spark.createDataFrame([("http://a.example",), (None,), ("",), ("x@y.example and ftp://z.example",)], "x string")
    for use in (D.defang_url, D.defang_text, D.defang_email):
        for r in rows.select(use(F.col("x")).alias("a")).select("a", use(F.col("a")).alias("b")).collect():
            assert r.a == r.b


def test_url_parts_of_hostile_links(spark):
    rows = {r.x: r for r in spark.createDataFrame([(u,) for u in ("http://under_score.example/a b|c", "https://user:pw@Host.example:8080/p?q#f", "http://[2001:db8::1]:80/x", "mailto:a@b.example", "no link")], "x string").select("x", HO.url_scheme(F.col("x")).alias("s"), HO.url_host(F.col("x")).alias("h"), HO.url_path_query(F.col("x")).alias("p")).collect()}
    assert rows["http://under_score.example/a b|c"].h == "under_score.example"
    assert rows["https://user:pw@Host.example:8080/p?q#f"].h == "host.example"
    assert rows["https://user:pw@Host.example:8080/p?q#f"].p == "/p?q"
    assert rows["http://[2001:db8::1]:80/x"].h == "2001:db8::1"
    assert rows["mailto:a@b.example"].h is None and rows["no link"].h is None


@pytest.mark.parametrize(("host", "want"), [("3405803785", "203.0.113.9"), ("0xcb007109", "203.0.113.9"), ("127.1", "127.0.0.1"), ("0177.0.0.1", "127.0.0.1"), ("1.2.3.4.", "1.2.3.4"), ("256.1.1.1", None), ("a.example", None), ("1.2.3.4.5", None), ("", None)])
def test_legacy_ipv4(spark, host, want):
    assert one(spark, host, HO.ipv4_of) == want
    if want:
        assert HO.web_ipv4(host) == want


def test_public_hosts():
    assert HO.public("203.0.113.9") is None and HO.public("8.8.8.8") == ("ip", "8.8.8.8") and HO.public("[::1]") is None
    assert HO.public("Example.com.") == ("name", "example.com") and HO.public("printer.local") is None and HO.public("localhost") is None
    assert HO.to_ascii("bücher.example") == "xn--bcher-kva.example"


def test_registrable_domains(spark):
    known = S.rules()
    assert len(known) > 5000
    for host, want in {"www.example.co.uk": "example.co.uk", "a.b.github.io": "b.github.io", "x.y.unknowntld": "x.y.unknowntld", "com": "com", "www.ck": "www.ck", "a.b.c.ck": "b.c.ck"}.items():
        assert S.registrable(host, known) == want, host
    assert one(spark, "login.paypal.co.uk", S.registrable_label) == "paypal"
    assert one(spark, "a.b.c", S.host_suffixes) == ["a.b.c", "b.c", "c"]
    assert one(spark, "mail.corp.example", lambda c: S.in_domain(c, ["corp.example"])) is True
    assert one(spark, "notcorp.example", lambda c: S.in_domain(c, ["corp.example"])) is False


@pytest.mark.parametrize(("a", "b", "want"), [("mircosoft", "microsoft", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0), ("paypla", "paypal", 1)])
def test_edit_distance(a, b, want):
    assert N.swap_distance(a, b) == want


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_is_symmetric(a, b):
    assert N.swap_distance(a, b) == N.swap_distance(b, a) <= max(len(a), len(b))


def test_names(spark):
    assert one(spark, "rnicr0s0ft", N.skeleton) == N.fold("rnicr0s0ft") == N.fold("microsoft")
    assert N.latin_fold("раураӏ") == N.fold("paypal") and N.decoded("xn--80ak6aa92e") == "аррӏе" and N.decoded("xn--!!") == "xn--!!"
    assert N.mixes_scripts("pаypal") and not N.mixes_scripts("việtnam") and not N.mixes_scripts("abcショップ")


@pytest.mark.parametrize(("head", "want"), [(b"%PDF-1.4", "application/pdf"), (b"MZ\x90", "application/x-dosexec"), (b"\xef\xbb\xbf <?xml version='1.0'?><!-- x --><svg>", "image/svg+xml"), (b"<!DOCTYPE HTML>", "text/html"), (b"stub" + b"PK\x05\x06" + b"\0" * 18, "application/zip"), (b"plain", None), (b"", None)])
def test_detected_type(spark, head, want):
    assert one(spark, bytearray(head), A.detected_type, "binary") == want


@pytest.mark.parametrize(("name", "declared", "detected", "want"), [
    ("invoice.pdf.exe", "application/pdf", "application/x-dosexec", ["executable", "double_extension", "type_mismatch"]),
    ("report.docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip", []),
    ("a.zip", "application/zip", "application/zip", ["archive"]),
    ("x.docm", None, "application/zip", ["macro_capable"]),
    ("page.html", "text/html", "text/html", ["html"]),
    ("gpj‮fdp.exe", None, None, ["executable", "double_extension"]),
    ("notes.txt", "text/plain", None, []),
    (None, None, None, []),
])
def test_flags(spark, name, declared, detected, want):
    row = spark.createDataFrame([(name, declared, detected)], "n string, d string, k string")
    assert row.select(A.flags(F.col("n"), F.col("d"), F.col("k"), F.lit(False))).first()[0] == want


def test_sizes_and_extensions(spark):
    assert [one(spark, n, A.human_size, "bigint") for n in (0, 1023, 1536, 5 * 1024**2, 3 * 1024**3)] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert one(spark, "A.Tar.GZ. ", A.extensions) == ["tar", "gz"] and one(spark, "none", A.extensions) == []


@pytest.mark.parametrize(("url", "value", "wrapper", "unresolved"), [
    ("https://nam02.safelinks.protection.outlook.com/?url=https%3A%2F%2Faccount-verify.example%2Flogin%3Fid%3D42&data=x", "https://account-verify.example/login?id=42", "safelinks", False),
    ("https://urldefense.proofpoint.com/v1/url?u=https%3A%2F%2Fwww.evil.example%2Fa%26b&k=1", "https://www.evil.example/a&b", "proofpoint", False),
    ("https://urldefense.proofpoint.com/v2/url?u=https-3A__secure-2Dupdate.example_portal&d=x", "https://secure-update.example/portal", "proofpoint", False),
    ("https://urldefense.com/v3/__https://reset-portal.example/p?q=a*b__;Kw!!x$", "https://reset-portal.example/p?q=a+b", "proofpoint", False),
    ("https://protect.mimecast.com/s/abc?domain=evil.example", "https://protect.mimecast.com/s/abc?domain=evil.example", "mimecast", True),
    ("https://secure-web.cisco.com/1abc/https%3A%2F%2Fx.example%2Fy", "https://x.example/y", "cisco", False),
    ("https://linkprotect.cudasvc.com/url?a=https%3a%2f%2fx.example&c=E", "https://x.example", "barracuda", False),
    ("https://plain.example/", "https://plain.example/", None, False),
    ("https://urldefense.com/v3/__https://a*b__;!!x$", "https://urldefense.com/v3/__https://a*b__;!!x$", "proofpoint", True),
])
def test_unwrap(url, value, wrapper, unresolved):
    got = L.unwrap(url)
    assert (got[0], got[2], got[3]) == (value, wrapper, unresolved)


def test_html():
    page = "<style>b{background:url('/c.png')}</style><p>Hi <a href='http://a.example'>see <b>this</b><a href=x>two</a><script>var s='h'</script><img src=i.png srcset='j.png 2x, k.png'><meta http-equiv=refresh content='0; url=\"http://r.example\"'>"
    got = H.inspect(page)
    assert got["anchors"] == [{"href": "http://a.example", "text": "see this"}, {"href": "x", "text": "two"}]
    assert got["resources"] == ["/c.png", "i.png", "j.png", "k.png"] and got["links"] == ["http://a.example", "x", "http://r.example"]
    assert "var s" in got["hidden_text"] and "var s" not in got["text"] and got["complete"]
    assert not H.inspect("x" * (H.LIMIT + 1))["complete"] and H.inspect(None) is None


@pytest.mark.parametrize(("content", "want"), [("0; url=http://a", "http://a"), ("5,URL = 'http://b' c", "http://b"), ("0; http://c", "http://c"), ("10", None), ("x; url=y", None), (".5;url=z", "z")])
def test_refresh(content, want):
    assert H.refresh_target(content) == want

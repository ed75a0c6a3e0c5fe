"""Messages end to end: bytes to score."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelark import settings as ST
from sievelark.operators import indicators as I
from sievelark.operators import rules as R
from sievelark.operators import scoring as SC
from sievelark.sources import mail as M

GOOD = b"""Received: from mx.shop.example (mx.shop.example [192.0.2.1]) by in.corp.example with ESMTP; Thu, 4 Jun 2026 10:00:00 +0200
Authentication-Results: in.corp.example; spf=pass smtp.mailfrom=shop.example; dkim=pass header.d=shop.example; dmarc=pass (p=reject)
From: Shop News <news@shop.example>
To: Jo <jo@corp.example>
Subject: =?utf-8?q?Summer_=C3=A9dition?=
Date: Thu, 4 Jun 2026 10:00:00 +0200
Return-Path: <news@shop.example>
Content-Type: multipart/alternative; boundary=b

--b
Content-Type: text/plain; charset=utf-8

Hello from https://shop.example/summer
--b
Content-Type: text/html; charset=utf-8

<p>Hello <a href="https://shop.example/summer">shop.example</a></p>
--b--
"""
BAD = b"""Authentication-Results: in.corp.example; spf=fail; dkim=fail header.d=x.example; dmarc=fail
Authentication-Results: other.example; spf=pass
From: "PayPal Service" <pay@paypa1.com>
Reply-To: claims@other-site.org
Return-Path: <bounce@mailer.net>
To: jo@corp.example
Subject: Urgent: verify now
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/html

<p>Your account has been locked. <a href="http://3405803785/login">www.paypal.com</a> <a href="https://bit.ly/x1">go</a></p>
--b
Content-Type: application/pdf; name="invoice.pdf.exe"
Content-Disposition: attachment; filename="invoice.pdf.exe"
Content-Transfer-Encoding: base64

""" + base64.b64encode(b"MZ\x90\x00 not a program") + b"""
--b--
"""


@pytest.fixture(scope="module")
def corpus(spark):
    files = [("/m/good.eml", GOOD), ("/m/bad.eml", BAD), ("/m/empty.eml", b""), ("/m/noise.eml", bytes(range(256)) * 4)]
    messages = M.parsed(spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")).cache()
    found, anomalies = I.extract(messages)
    return R.Corpus(messages, found.cache(), ST.Settings()), anomalies


def test_parsed_fields(corpus):
    rows = {r.filename: r for r in corpus[0].messages.collect()}
    good = rows["good.eml"]
    assert good.subject == "Summer édition" and good.date_iso == "2026-06-04T10:00:00+02:00" and good.auth.dmarc.result == "pass"
    assert good.addresses["from"].domain == "shop.example" and good.routing[0]["by"] == "in.corp.example" and good.body.has_html
    bad = rows["bad.eml"]
    assert [a.code for a in bad.anomalies] == ["auth_untrusted_results"] and not bad.anomalies[0].coverage_gap
    assert bad.attachments[0].detected_type == "application/x-dosexec" and bad.attachments[0].flags == ["executable", "double_extension", "type_mismatch"]
    assert "missing_from" in [a.code for a in rows["empty.eml"].anomalies] and rows["noise.eml"].msg_id


def test_indicators(corpus):
    bad = corpus[0].messages.where("filename = 'bad.eml'").first().msg_id
    rows = {(r.type, r.value): r for r in corpus[0].indicators.where(F.col("msg_id") == bad).collect()}
    assert ("ipv4", "203.0.113.9") in rows and ("domain", "paypa1.com") in rows and ("url", "https://bit.ly/x1") in rows
    assert rows["url", "https://bit.ly/x1"].defanged == "hxxps://bit[.]ly/x1" and rows["domain", "paypa1.com"].provenance == ["header:From"]
    assert sorted(r.ord for r in rows.values()) == list(range(len(rows)))


def test_scores(corpus):
    c, anomalies = corpus
    fired = R.fired(c).cache()
    ids = {m.msg_id: m.filename for m in c.messages.collect()}
    got: dict = {}
    for r in fired.collect():
        got.setdefault(ids[r.msg_id], {})[r.rule_id] = r.evidence
    assert "good.eml" not in got
    assert set(got["bad.eml"]) == {
        "auth.spf_fail", "auth.dkim_fail", "auth.dmarc_fail", "identity.display_name_brand_mismatch", "identity.return_path_mismatch", "identity.reply_to_mismatch", "url.lookalike", "url.raw_ip_host",
        "url.shortener", "url.credential_keywords", "attach.executable", "attach.double_extension", "attach.type_mismatch", "content.urgency_keywords",
    }
    assert got["bad.eml"]["url.lookalike"] == ["paypa1[.]com is a lookalike of paypal[.]com (confusable characters)"]
    scores = {ids[r.msg_id]: r for r in SC.scores(c.messages, fired, anomalies, c.settings).collect()}
    assert scores["good.eml"].score == 0 and scores["good.eml"].analysis_complete and scores["good.eml"].severity == "minimal"
    assert scores["bad.eml"].score == 100 and scores["bad.eml"].verdict == "Very high suspicion" and scores["bad.eml"].severity == "critical"
    top = SC.reasons(fired, c.settings, 2).collect()
    assert max(len(r.reasons) for r in top) == 2


@pytest.mark.parametrize(("domain", "reason"), [("paypa1.com", "confusable characters"), ("login.rnicrosoft.net", "confusable characters"), ("paypal-secure.net", 'embeds the name "paypal" with "secure"'), ("mircosoft.com", "edit distance 1"), ("paypal.com", None), ("www.paypal.com", None), ("amazon.ca", None), ("life.com", None), ("amazing.com", None), ("example.com", None)])
def test_lookalikes(spark, domain, reason):
    c = R.Corpus.__new__(R.Corpus)
    c.settings = ST.Settings()
    found = R.lookalikes(spark.createDataFrame([(domain,)], "d string"), R.Corpus.targets.fget(c), c.settings).collect()
    assert [r.reason for r in found] == ([reason] if reason else [])


def test_authentication_clauses():
    value = 'mx.example (a; b "c"); spf=pass (sender; ok) smtp.mailfrom=a.example; dkim=hardfail/1 = x; dkim=pass header.d=esp.example; dkim=fail header.i=@shop.example; arc=pass'
    assert M.server_id(value) == "mx.example" and M.server_id("spf=pass") == ""
    assert [(m, s) for m, s, _ in M.results(value)] == [("spf", "pass"), ("dkim", "fail"), ("dkim", "pass"), ("dkim", "fail")]
    auth, _ = M.authentication([value], [], "shop.example")
    assert auth["dkim"]["result"] == "fail" and auth["dkim"]["detail"] == "header.i=@shop.example"
    auth, _ = M.authentication([], ["SoftFail (not listed) client-ip=1.2.3.4", "pass"], None)
    assert auth["spf"] == {"result": "softfail", "detail": "not listed"}


def test_embedded_and_zip(spark):
    outer = b"From: a@b.example\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: message/rfc822\n\nFrom: in@x.example\nSubject: inner\n\nhi\n--q--\n"
    own = M.embedded(outer)
    assert len(own) == 1 and M.parse(own[0]["data"], "i.eml")["subject"] == "inner"
    rows = M.embedded_rows(spark.createDataFrame([("p", bytearray(outer)), ("q", bytearray(b""))], "path string, content binary")).collect()
    assert [(r.path, r["index"]) for r in rows] == [("p", 0)]
    store = io.BytesIO()
    with zipfile.ZipFile(store, "w") as z:
        z.writestr("a", "b")
    data = bytearray(store.getvalue())
    assert not M.encrypted_zip(bytes(data))
    data[data.find(b"PK\x01\x02") + 8] |= 1
    assert M.encrypted_zip(bytes(data)) and not M.encrypted_zip(b"PK\x05\x06")


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(GOOD)
    (tmp_path / "b.txt").write_bytes(b"x")
    messages, rejects = M.read(spark, str(tmp_path))
    assert messages.count() == 1 and [r.reason for r in rejects.collect()] == ["unsupported_format"]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("weights:\n  auth.spf_fail: 20\norg_domains: ['*.Corp.example.']\n")
    own = ST.load(str(path))
    assert own.weight("auth.spf_fail") == 20 and own.weight("auth.dkim_fail") == 12 and own.org_domains == ["corp.example"] and own.weight("none") == 0
    for raw in ({"weigths": {}}, {"weights": {"auth.spf_fial": 1}}, {"weights": {"auth.spf_fail": 101}}, {"bands": [{"max": 50, "verdict": "x"}]}):
        with pytest.raises(ST.SettingsError):
            ST.validated(raw)


def test_reports(corpus):
    import json

    from sievelark.operators import report as RP

    c, anomalies = corpus
    fired = R.fired(c, ["auth.spf_fail", "url.shortener", "attach.executable", "content.urgency_keywords"]).cache()
    scores = SC.scores(c.messages, fired, anomalies, c.settings)
    built = RP.build(c.messages, c.indicators, fired, scores, c.settings).cache()
    ids = {m.msg_id: m.filename for m in c.messages.select("msg_id", "filename").collect()}
    reports = {ids[r.msg_id]: json.loads(r.json) for r in RP.to_json(built).collect()}
    bad = reports["bad.eml"]
    assert [r["id"] for r in bad["reasons"]] == ["attach.executable", "auth.spf_fail", "url.shortener", "content.urgency_keywords"] and bad["summary"]["score"] == 47
    assert bad["identity"]["from"]["address"] == "pay[at]paypa1[.]com" and bad["attachments"][0]["size"] == "18 B"
    assert set(reports) == {"good.eml", "bad.eml", "empty.eml", "noise.eml"}
    pages = {ids[r.msg_id]: r.html for r in RP.to_html(built).collect()}
    for text in [*pages.values(), *(json.dumps({k: v for k, v in r.items()}) for r in reports.values())]:
        assert "http://" not in text and "https://" not in text and "<a " not in text and "<script" not in text
    assert RP.terminal(bad, 2, 1).count("\n") <= 2 + len(RP.ORDER)
    own = {(ids[r.msg_id], r.bucket): r for r in RP.buckets(c.indicators, 1).collect()}
    assert len(own["bad.eml", "urls"].shown) == 1 and own["bad.eml", "urls"].n >= 2

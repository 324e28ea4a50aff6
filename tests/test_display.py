"""Texts for display: each input and what the interface makes of it."""

import pytest
from pyspark.sql import functions as F

from tallylog.functions import display

CASES = {}


def case(name, use, cases):
    CASES[name] = (use, cases)


case("method_class_cases", display.method_class, [("GET", "m-read"), ("get", "m-read"), ("OPTIONS", "m-read"), ("Trace", "m-read"), ("CONNECT", "m-write"), ("patch", "m-write"), ("delete", "m-del"), ("PROPFIND", "m-odd"), ("", "m-none"), (None, "m-none")])
case("level_class_cases", display.level_class, [("core:error", "s5"), ("EMERG", "s5"), ("alert", "s5"), ("crit", "s5"), ("err", "s0"), ("warn", "s4"), ("ssl:Warning", "s4"), ("notice", "s0"), ("", "s0")])
case("error_text_cases", display.error_text, [
    ('{"message":"m","error_code":"AH01"}', "AH01 m"), ('{"level":"warn","client":"1.2.3.4:5","pid":"7","tid":"","z":"q"}', "pid=7, z=q"), ('{"message":"","a":"b"}', "a=b"),
    ('{"message":"only"}', "only"), ("no object", ""), (None, ""), ('{"level":"warn"}', ""),
])
case("url_decoded_cases", display.url_decoded, [
    ("/a%20b%zz", "/a b%zz"), ("%ff", "%ff"), ("/%ea%b0%80?x=%EA%B0%80", "/가?x=가"), ("a+b%2B", "a+b+"), ("100%", "100%"), ("%41%ff%42", "%41%ff%42"), ("%41x%ff", "Ax%ff"), ("plain", "plain"), ("%C0%80", "%C0%80"), (None, None),
])
case("hex_decoded_cases", display.hex_decoded, [
    (r"\xe3\x81\x82", "あ"), (r"a\x00b\x7F", "a·b·"), (r"\xff\x41", "·A"), (r"\x4", r"\x4"), (r"가\xEA\xB0\x80", "가가"), (r"\x22q\x22", '"q"'), ("plain", "plain"), (r"\xEF\xBB\xBFx", "x"), (r"\xC2\x85", "·"),
])
_TLS = " ClientHello — HTTPS 핸드셰이크를 HTTP 포트로 보냄"
case("protocol_cases", display.protocol_guess, [
    (r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x03", "TLS 1.2+" + _TLS), (r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x02", "TLS 1.1" + _TLS), (r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x01", "TLS 1.0" + _TLS),
    (r"\x16\x03\x01\x02\x00\x01", "TLS" + _TLS), (r"\x16\x03\x01\x02\x00\x02", None), (r"\x16\x03\x05\x02\x00\x01", None), (r"\x80.\x01\x03", "SSLv2 ClientHello(구식 스캐너)"), (r"\x05\x02\x00\x02", "SOCKS5 핸드셰이크"),
    (r"\x05\x03", "SOCKS5 핸드셰이크"), (r"\x05\x04", None), (r"\x04\x01\x00P", "SOCKS4 CONNECT"), (r"\x00\x00\x00\x08", "길이 접두 이진 프로토콜(예: RDP/Java 직렬화)"), (r"\x00\x00\x00\x07", None), ("GET / HTTP/1.1", None),
])
_HELLO = r"\x16\x03\x01\x00\x50\x01\x00\x00\x4C\x03\x03" + "r" * 32 + r"\x02ab\x00\x02cc\x01\x00"
case("server_name_cases", display.server_name, [
    (_HELLO + r"\x00\x14" + r"\x00\x05\x00\x01z" + r"\x00\x00\x00\x0B\x00\x09\x00\x00\x06a.test", "a.test"), (_HELLO + r"\x00\x0F" + r"\x00\x00\x00\x0B\x00\x09\x00\x00\x06b.test", "b.test"),
    (_HELLO + r"\x00\x0F" + r"\x00\x00\x00\x0B\x00\x09\x00\x00\x06b.te", None), (_HELLO + r"\x00\x05" + r"\x00\x05\x00\x01z", None), (_HELLO, None), (r"\x16\x03\x01", None), ("GET /", None),
])
case("natural_name_order", lambda c: F.array_join(F.transform(F.array_sort(F.transform(F.split(c, " "), lambda n: F.struct(display.natural_key(n).alias("k"), n.alias("n")))), lambda s: s["n"]), " "), [
    ("access.log.10 access.log.2 access.log", "access.log access.log.2 access.log.10"), ("b1 A2 a10 a9", "A2 a9 a10 b1"), ("x007 x8 x09", "x007 x8 x09"),
])
case("base_name_cases", display.base_name, [("/var/log/a.log", "a.log"), (r"C:\logs\b.log", "b.log"), ("/var/log/", "log"), ("", ""), ("x", "x")])



@pytest.mark.parametrize("name", CASES)
def test_texts(spark, name):
    use, cases = CASES[name]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, given string")
    got = [r.text for r in rows.select("k", use(F.col("given")).alias("text")).orderBy("k").collect()]
    assert got == [b for _, b in cases]

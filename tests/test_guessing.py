"""Formats told from example lines."""

from pyspark.sql import functions as F

from tallylog.sources import formats, guessing, lines, parse, vocabulary

LINE = '203.0.113.4 - - [06/Apr/2022:01:02:03 +0000] "GET /n/1 HTTP/1.1" 200 17 "http://yard.example/" "Reader 1" 0.25 88'


def kinds(line):
    return [g.kind for g in guessing.guesses(guessing.pieces(line, guessing.separator(line)))]


def test_pieces_and_kinds():
    assert kinds(LINE) == ["client_ip", "ignore", "ignore", "timestamp", "request_line", "status", "bytes_sent", "referrer", "user_agent", "text", "integer"]
    assert kinds("2022-04-06 01:02:03 GET /a HTTP/2 404 404 404") == ["timestamp", "method", "request_target", "protocol", "status", "bytes_sent", "integer"]
    assert [p.value for p in guessing.pieces("2022/04/06 01:02:03 [error] 7#8: *9 x")] == ["2022/04/06 01:02:03", "error", "7#8:", "*9", "x"]
    assert [guessing.separator(x) for x in ("a|b|c|d", "a\tb\tc\td", "a,b,c,d", "a, b, c, d", "a;b;c;d", "a b")] == ["|", "\t", ",", None, ";", None]
    assert kinds("::1|GET|/x|200") == ["client_ip", "method", "request_target", "status"]
    assert guessing.pieces('"a \\" b" [open') == [("a \\\" b", "quoted"), ("open", "bracketed")]


def test_guessed_profiles_parse(spark, tmp_path):
    path = tmp_path / "own.log"
    path.write_text("".join(LINE.replace("/n/1", f"/n/{k}") + "\n" for k in range(30)))
    (made,) = guessing.profiles(lines.read_heads(spark, [(1, str(path))])).values()
    assert not formats.validate(made)
    got = parse.records(parse.parse(lines.read_sources(spark, [(1, str(path))]), made))
    row = got.where("line_number = 3").first()
    assert got.count() == 30 and (row.client_ip, row.request_target, row.status, row.bytes_sent, row.referrer, row.user_agent) == ("203.0.113.4", "/n/2", 200, 17, "http://yard.example/", "Reader 1")
    assert got.select(F.get_json_object("extra_json", "$.field_10")).first()[0] == "0.25"


def test_terms_and_labels():
    assert [len(vocabulary.vocabulary(s)) for s in ("nginx", "apache", "unknown")] == [45, 33, 15]
    assert vocabulary.term_of(vocabulary.NGINX, "timestamp", time_format="iso8601") == "$time_iso8601" and vocabulary.term_of(vocabulary.APACHE, "timestamp") == "%t"
    assert vocabulary.term_of(vocabulary.NGINX, "integer", "pid") == "$pid" and vocabulary.term_of(vocabulary.GENERIC, "text") == "text"
    assert vocabulary.field_label("status") == "상태코드" and vocabulary.field_label("duration_us") == "처리 시간(μs)" and vocabulary.field_label("field_3") == "field_3"


NGINX = '2031/05/06 07:08:09 [warn] 31#9: *77 slow answer, quite, client: 192.0.2.31, server: shop.test, request: "POST /pay HTTP/1.1", upstream: "http://10.9.8.7:81/pay", host: "shop.test"'
APACHE = "[Tue May 06 07:08:09.125000 2031] [proxy:error] [pid 31:tid 9] [client 192.0.2.31:5000] AH01114: no answer from it, referer: http://shop.test/cart"


def test_roles_of_error_lines():
    roles = lambda line, server: guessing.error_roles(guessing.pieces(line), server)
    assert roles(NGINX, "nginx")[:6] == ["timestamp", "level", "pid_tid", "connection", "message", "ignore"]
    assert roles(APACHE, "apache")[:6] == ["timestamp", "level", "pid_tid", "client", "error_code", "message"]
    assert roles("[Tue May 06 07:08:09 2031] [crit] [mod_ssl.c(12)] (2)No such thing", "apache")[:4] == ["timestamp", "level", "source_file", "os_error"]
    assert roles(NGINX, "unknown")[:5] == ["timestamp", "level", "source", "source", "message"]
    assert roles("plain words only", "nginx") == ["message", "ignore", "ignore"]


def test_profiles_of_error_lines_parse_and_lead_back(spark):
    for line, server in ((NGINX, "nginx"), (APACHE, "apache")):
        made = guessing.error_profile(line, server)
        assert not formats.validate(made)
        parts = guessing.pieces(line)
        roles = guessing.error_roles(parts, server)
        back = guessing.roles_of(made, parts)
        upto = roles.index("message") + 1
        assert back[:upto] == roles[:upto] and set(back[upto:]) <= {"ignore"}
    rows = [(1, 1, NGINX), (1, 2, NGINX.replace(" *77", "").split(", client")[0]), (1, 3, NGINX.split(", upstream")[0])]
    got = parse.parse(spark.createDataFrame(rows, "source_id long, line_number long, value string"), guessing.error_profile(NGINX, "nginx")).orderBy("line_number").collect()
    assert [r.kind for r in got] == ["record"] * 3
    first = got[0].record
    assert (first.client_ip, first.method, first.request_target, first.extra["message"], first.extra["upstream"], first.extra["level"], first.extra["connection"]) == ("192.0.2.31", "POST", "/pay", "slow answer, quite", "http://10.9.8.7:81/pay", "warn", "*77")
    assert first.tz_offset_seconds == 9 * 3600 and got[1].record.extra["message"] == "slow answer, quite" and got[1].record.client_ip is None and "host" not in got[2].record.extra
    (row,) = parse.parse(spark.createDataFrame([(1, 1, APACHE)], "source_id long, line_number long, value string"), guessing.error_profile(APACHE, "apache")).collect()
    assert row.record.extra["error_code"] == "AH01114:" and row.record.referrer == "http://shop.test/cart" and row.record.extra["message"] == "no answer from it"


def test_presets_lead_to_roles():
    assert guessing.roles_of(formats.preset("combined"), guessing.pieces(LINE)) == ["client_ip", "ident", "remote_user", "timestamp", "request", "status", "bytes_sent", "referrer", "user_agent", "ignore", "ignore"]
    assert guessing.roles_of(formats.preset("w3c"), []) is None
    made = guessing.profile(LINE)
    assert [r for r in guessing.roles_of(made, guessing.pieces(LINE))][3:8] == ["timestamp", "request", "status", "bytes_sent", "referrer"]


def test_labels_after_a_message():
    parts = guessing.pieces(NGINX)
    labels = guessing.tail_labels(parts, guessing.error_roles(parts, "nginx").index("message"), guessing.TAILS["nginx"])
    told = {parts[k].value: v for k, v in labels.items()}
    assert told["client:"] == ("클라이언트 IP", "client_ip") and told["192.0.2.31,"] == ("", "client_ip") and told["request:"][1] == "request_line" and "slow" not in told

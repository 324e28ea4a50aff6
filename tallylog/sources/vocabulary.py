"""Names of log fields: what servers call them, how they are shown, which kind they are and where they are stored."""

from __future__ import annotations

from typing import NamedTuple


class Term(NamedTuple):
    id: str
    label: str
    kind: str
    name: str


#: fixed values: terms of nginx access logs (variable, label, kind, stored name)
NGINX = (
    Term("$remote_addr", "클라이언트 IP", "client_ip", "client_ip"),
    Term("$remote_port", "클라이언트 포트", "integer", "remote_port"),
    Term("$remote_user", "로그인 사용자", "text", "remote_user"),
    Term("$http_x_forwarded_for", "프록시 원본 IP", "text", "x_forwarded_for"),
    Term("$http_x_real_ip", "실제 IP 헤더", "text", "x_real_ip"),
    Term("$time_local", "요청 시각", "timestamp", "timestamp"),
    Term("$time_iso8601", "요청 시각(ISO)", "timestamp", "timestamp"),
    Term("$msec", "요청 시각(초.밀리초)", "text", "msec"),
    Term("$request_time", "처리 시간(초)", "text", "request_time"),
    Term("$request", "요청 라인", "request_line", "request"),
    Term("$request_method", "요청 방식", "method", "method"),
    Term("$request_uri", "요청 URI", "request_target", "request_target"),
    Term("$uri", "경로", "text", "uri"),
    Term("$document_uri", "경로(document)", "text", "document_uri"),
    Term("$query_string", "쿼리 문자열", "text", "query_string"),
    Term("$args", "쿼리 문자열(args)", "text", "args"),
    Term("$request_length", "요청 크기", "integer", "request_length"),
    Term("$server_protocol", "프로토콜", "protocol", "protocol"),
    Term("$scheme", "스킴", "text", "scheme"),
    Term("$host", "호스트", "text", "host"),
    Term("$http_host", "Host 헤더", "text", "http_host"),
    Term("$http_referer", "리퍼러", "referrer", "referrer"),
    Term("$http_user_agent", "브라우저(UA)", "user_agent", "user_agent"),
    Term("$http_cookie", "쿠키", "text", "cookie"),
    Term("$status", "상태코드", "status", "status"),
    Term("$body_bytes_sent", "응답 크기", "bytes_sent", "bytes_sent"),
    Term("$bytes_sent", "전송 크기(헤더 포함)", "integer", "bytes_sent_total"),
    Term("$gzip_ratio", "압축률", "text", "gzip_ratio"),
    Term("$server_name", "서버 이름", "text", "server_name"),
    Term("$server_addr", "서버 주소", "text", "server_addr"),
    Term("$server_port", "서버 포트", "integer", "server_port"),
    Term("$upstream_addr", "업스트림 주소", "text", "upstream_addr"),
    Term("$upstream_status", "업스트림 상태코드", "text", "upstream_status"),
    Term("$upstream_response_time", "업스트림 응답 시간", "text", "upstream_response_time"),
    Term("$upstream_connect_time", "업스트림 연결 시간", "text", "upstream_connect_time"),
    Term("$upstream_header_time", "업스트림 헤더 시간", "text", "upstream_header_time"),
    Term("$upstream_cache_status", "캐시 상태", "text", "upstream_cache_status"),
    Term("$connection", "연결 번호", "integer", "connection"),
    Term("$connection_requests", "연결의 요청 수", "integer", "connection_requests"),
    Term("$pipe", "파이프라인", "text", "pipe"),
    Term("$ssl_protocol", "TLS 버전", "text", "ssl_protocol"),
    Term("$ssl_cipher", "TLS 암호", "text", "ssl_cipher"),
    Term("$request_id", "요청 ID", "text", "request_id"),
    Term("$hostname", "서버 호스트명", "text", "hostname"),
    Term("$pid", "프로세스 ID", "integer", "pid"),
)
#: fixed values: terms of Apache access logs
APACHE = (
    Term("%h", "클라이언트 IP", "client_ip", "client_ip"),
    Term("%a", "클라이언트 IP(원본)", "text", "peer_ip"),
    Term("%l", "identd", "text", "ident"),
    Term("%u", "로그인 사용자", "text", "remote_user"),
    Term("%{X-Forwarded-For}i", "프록시 원본 IP", "text", "x_forwarded_for"),
    Term("%t", "요청 시각", "timestamp", "timestamp"),
    Term("%D", "처리 시간(μs)", "integer", "duration_us"),
    Term("%T", "처리 시간(초)", "integer", "duration_s"),
    Term("%{ms}T", "처리 시간(ms)", "integer", "duration_ms"),
    Term("%r", "요청 라인", "request_line", "request"),
    Term("%m", "요청 방식", "method", "method"),
    Term("%U", "경로", "request_target", "request_target"),
    Term("%q", "쿼리 문자열", "text", "query_string"),
    Term("%H", "프로토콜", "protocol", "protocol"),
    Term("%{Referer}i", "리퍼러", "referrer", "referrer"),
    Term("%{User-Agent}i", "브라우저(UA)", "user_agent", "user_agent"),
    Term("%{Host}i", "Host 헤더", "text", "host"),
    Term("%f", "파일 이름", "text", "filename"),
    Term("%R", "핸들러", "text", "handler"),
    Term("%>s", "상태코드", "status", "status"),
    Term("%s", "최초 상태코드", "integer", "status_first"),
    Term("%b", "응답 크기", "bytes_sent", "bytes_sent"),
    Term("%B", "응답 크기(0 표기)", "integer", "bytes_body"),
    Term("%O", "보낸 크기(헤더 포함)", "integer", "bytes_out"),
    Term("%I", "받은 크기(헤더 포함)", "integer", "bytes_in"),
    Term("%S", "송수신 합계", "integer", "bytes_transferred"),
    Term("%v", "서버 이름", "text", "server_name"),
    Term("%V", "정식 서버 이름", "text", "server_name_canonical"),
    Term("%p", "서버 포트", "integer", "server_port"),
    Term("%A", "서버 IP", "text", "local_ip"),
    Term("%P", "프로세스 ID", "integer", "pid"),
    Term("%L", "로그 ID", "text", "log_id"),
    Term("%k", "keepalive 순번", "integer", "keepalive"),
)
#: fixed values: terms where the server isn't known
GENERIC = (
    Term("timestamp", "시간", "timestamp", "timestamp"),
    Term("client_ip", "IP", "client_ip", "client_ip"),
    Term("remote_user", "사용자", "text", "remote_user"),
    Term("ident", "identd", "text", "ident"),
    Term("x_forwarded_for", "X-Forwarded-For", "text", "x_forwarded_for"),
    Term("request_line", "요청문", "request_line", "request"),
    Term("method", "메서드", "method", "method"),
    Term("request_target", "URL", "request_target", "request_target"),
    Term("protocol", "프로토콜", "protocol", "protocol"),
    Term("host", "호스트", "text", "host"),
    Term("referrer", "리퍼러", "referrer", "referrer"),
    Term("user_agent", "UA", "user_agent", "user_agent"),
    Term("status", "상태코드", "status", "status"),
    Term("bytes_sent", "바이트", "bytes_sent", "bytes_sent"),
    Term("request_time", "응답 시간", "text", "request_time"),
)
#: fixed values: labels of stored names that come before the terms'
CORE = {
    "timestamp": "시간", "client_ip": "IP", "request": "요청 라인", "method": "메서드", "request_target": "URL", "protocol": "프로토콜", "status": "상태코드", "bytes_sent": "응답 크기",
    "referrer": "리퍼러", "user_agent": "브라우저(UA)", "message": "메시지", "level": "레벨",
}
#: fixed values: labels of names that only error logs have, nginx before Apache before others
ERRORS = {
    "pid_tid": "프로세스#스레드", "connection": "연결 번호", "client": "클라이언트", "log_id": "요청 ID", "source_file": "소스 파일:줄", "os_error": "APR/OS 오류", "error_code": "오류 코드", "source": "출처",
    "server": "서버", "upstream": "업스트림", "host": "호스트",
}


def vocabulary(server: str) -> tuple[Term, ...]:
    return {"nginx": NGINX, "apache": APACHE}.get(server, GENERIC)


def field_label(name: str) -> str:
    """How a stored field is called where it is shown; an unknown one by its name."""
    if name in CORE:
        return CORE[name]
    found = next((t.label for terms in (NGINX, APACHE, GENERIC) for t in terms if t.name == name), None)
    return found or ERRORS.get(name, name)


def term_of(terms: tuple[Term, ...], kind: str, name: str | None = None, time_format: str | None = None) -> str:
    """The term for a field of some kind: by name, a time by its format, else the first of the kind; numbers and texts have no term of their own."""
    same = [t for t in terms if t.kind == kind]
    if name and (own := next((t for t in same if t.name == name), None)):
        return own.id
    if kind == "timestamp" and time_format == "iso8601":
        same = [t for t in same if t.id == "$time_iso8601"] or same
    return kind if kind in ("text", "integer") or not same else same[0].id

"""The rules that come with the engine."""

from __future__ import annotations

from tallylog.operators.rules import Rule, parse_rule

# fixed values: what the rules look for
ACCESS = {
    "all_requests": ("", "true"),
    "ok_responses": ("", "status in 200..299"),
    "page_requests": (
        r"$asset = /\.(?:js|mjs|cjs|css|map|png|jpe?g|gif|webp|avif|svg|ico|bmp|cur|woff2?|ttf|otf|eot|mp4|webm|ogg|mp3|wav|pdf|zip|gz|swf|txt)(?:\?|#|$)/ nocase",
        "path is null or not $asset",
    ),
    "sql_injection": (
        r"""
        $union = /union[%20\s+]+(all[%20\s+]+)?select/ nocase
        $quote = /'\s*(or|and)\s*'?\d/ nocase
        $tauto = /\b(or|and)\s+\d+\s*=\s*\d+/ nocase
        $func = /sleep\(\d|benchmark\(|load_file\(|xp_cmdshell|information_schema/ nocase
        $enc = "%27"
        $cmt = /--\s|;\s*--|\/\*.*\*\//
        """,
        "any of them",
    ),
    "xss": (
        r"""
        $tag = /<script|%3cscript|%3c%2fscript/ nocase
        $js = "javascript:" nocase
        $evt = /on(error|load)\s*=/ nocase
        $call = /alert\(|document\.cookie/ nocase
        """,
        "any of them",
    ),
    "path_traversal": (r"$dots = /\.\.\/|\.\.\\|%2e%2e%2f|%2e%2e\/|\.\.%2f|%252e%252e/ nocase", "$dots"),
    "command_injection": (
        r"""
        $semi = /;\s*(cat|ls|id|whoami|wget|curl|nc|bash|sh)\b/ nocase
        $pipe = /\|\s*(cat|ls|id|whoami|wget|curl)\b/ nocase
        $subst = /%60|\$\(|%7c%20/
        $shell = /\/bin\/(ba)?sh/
        """,
        "any of them",
    ),
    "scanner_paths": (
        r"""
        $wp = /\/wp-login\.php|\/wp-admin|\/xmlrpc\.php/ nocase
        $admin = /\/phpmyadmin|\/manager\/html|\/actuator\//i
        $files = /\/\.env|\/\.git\/|\/\.aws\/|\/etc\/passwd|\/config\.php|\/shell\.php|\/cgi-bin\// nocase
        """,
        "any of them",
    ),
    "sqlmap": (
        r"""
        $hexmark = /0x71[0-9a-f]{4,}71/ nocase
        $chrmark = /chr(?:\(|%28)113(?:\)|%29)(?:\|\||%7c%7c)/ nocase
        $charmark = /char(?:\(|%28)113(?:\)|%29)(?:\+|%2b)/ nocase
        $funcs = /(?:extractvalue|updatexml|gtid_subset|json_keys|make_set|elt|benchmark|pg_sleep)(?:\(|%28)|procedure(?:\s|%20|\+)+analyse|waitfor(?:\s|%20|\+)+delay|sleep(?:\(|%28)\d/ nocase
        $taut = /(?:^|%20|\+|[^a-z0-9_])(?:and|or)(?:\s|%20|\+)+\d{4}(?:=|%3d)\d{4}/ nocase
        $union = /union(?:\s|%20|\+)+all(?:\s|%20|\+)+select(?:\s|%20|\+)+null/ nocase
        $casewhen = /select(?:\s|%20|\+)+(?:\(|%28)case(?:\s|%20|\+)+when/ nocase
        $ua = /sqlmap/ nocase
        """,
        "ua contains $ua or any of ($hexmark, $chrmark, $charmark, $funcs, $taut, $union, $casewhen)",
    ),
    "scanner_tools": (
        "$tools = /nikto|nuclei|masscan|zgrab|nmap|dirbuster|gobuster|ffuf|feroxbuster|acunetix|nessus|wpscan|whatweb|openvas|burp|arachni/ nocase",
        "ua contains $tools",
    ),
    "log4shell": (
        r"""
        $plain = /\$\{jndi:/ nocase
        $enc = /%24%7bjndi/ nocase
        $obf = /\$\{(?:lower|upper|env|sys|::-)[^}]*\}(?:j|\$)/ nocase
        """,
        "any of them",
    ),
    "lfi_ssrf": (
        r"""
        $wrap = /(?:php|file|data|expect|zip|phar):(?:\/\/|%2f%2f)/ nocase
        $proc = /\/proc\/self|\/etc\/shadow|win\.ini|boot\.ini/ nocase
        $ssrf = /[?&](?:url|uri|target|dest|redirect|next|src|feed)=(?:https?(?::|%3a)(?:\/\/|%2f%2f))?(?:127\.0\.0\.1|localhost|169\.254\.169\.254|10\.\d+\.\d+\.\d+|192\.168\.)/ nocase
        """,
        "any of them",
    ),
    "webshell_upload": (
        r"""
        $upload = /\/(?:upload|uploads|files|attach|attachments|tmp|temp)\/[^?]*\.(?:php\d?|phtml|jsp|jspx|asp|aspx|cgi)/ nocase
        $param = /[?&](?:cmd|exec|command|execute|shell)=/ nocase
        $calls = /(?:eval|assert|system|passthru|shell_exec|base64_decode)(?:\(|%28)/ nocase
        """,
        "any of them",
    ),
    "bots": (r"$tools = /python|curl|wget|go-http-client|scrapy|libwww|httpclient|okhttp|java\// nocase", "ua contains $tools or ua is null"),
}
ERROR = {
    "all_errors": ("", "true"),
    "severe_levels": ("$sev = /crit|alert|emerg/ nocase", "level matches $sev"),
    "error_level": ("$lv = /error/ nocase", "level matches $lv"),
    "warn_level": ("$lv = /warn/ nocase", "level matches $lv"),
    "file_missing": ('$nginx = "No such file or directory" nocase $stat = "stat() failed" nocase $apache = "File does not exist" nocase', "any of them"),
    "permission_denied": ('$perm = "Permission denied" nocase $denied = "denied by server configuration" nocase', "any of them"),
    "upstream_failed": (
        """
        $refused = "Connection refused" nocase
        $timeout = "upstream timed out" nocase
        $nolive = "no live upstreams" nocase
        $closed = "upstream prematurely closed connection" nocase
        $reset = "Connection reset by peer" nocase
        $hdr = "upstream sent too big header" nocase
        """,
        "any of them",
    ),
    "body_too_large": ('$big = "client intended to send too large body" nocase $ent = "Request Entity Too Large" nocase', "any of them"),
    "ssl_handshake": ('$hs = "SSL_do_handshake" nocase $rt = "SSL routines" nocase $err = "SSL handshake error" nocase $read = "SSL_read() failed" nocase', "any of them"),
    "php_fastcgi": ('$fcgi = "FastCGI sent in stderr" nocase $php = "PHP message" nocase $fatal = "PHP Fatal error" nocase', "any of them"),
    "directory_index_forbidden": ('$nginx = "directory index of" nocase $apache = "Directory index forbidden" nocase', "any of them"),
}


def source(name: str) -> tuple[str, str]:
    """(kind, text) of a rule."""
    kind = "access" if name in ACCESS else "error"
    strings, condition = (ACCESS if kind == "access" else ERROR)[name]
    return kind, f"rule {name}\n{{\n" + (f"    strings:\n        {strings.strip()}\n" if strings else "") + f"    condition:\n        {condition}\n}}"


def builtin(name: str) -> tuple[str, Rule]:
    kind, text = source(name)
    return kind, parse_rule(text, kind)

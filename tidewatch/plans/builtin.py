"""Rules that come with the engine, over the packets of sources.dissect with their flows' direction.

They are made from tables, one for each kind of evidence that our packets have: connections that are opened, names that
are asked for or greeted, requests and their headers, answers, payloads without a dissector, and rates. A row says what
public documents say of a service, a protocol or an advisory (by its CVE number); a table's function makes rules of it.
"""

from __future__ import annotations

import re
from typing import Any

#: Services on their registered ports (IANA) that should not be opened to the Internet, with severity and ATT&CK technique.
EXPOSED = {
    "cassandra": ((7000, 9042), "HIGH", "T1190"),
    "docker": ((2375, 2376), "HIGH", "T1610"),
    "elasticsearch": ((9200,), "HIGH", "T1190"),
    "etcd": ((2379,), "HIGH", "T1190"),
    "kubelet": ((10250,), "HIGH", "T1609"),
    "memcached": ((11211,), "HIGH", "T1190"),
    "mongodb": ((27017,), "HIGH", "T1190"),
    "mssql": ((1433,), "HIGH", "T1190"),
    "mysql": ((3306,), "HIGH", "T1190"),
    "oracle": ((1521,), "HIGH", "T1190"),
    "postgresql": ((5432,), "HIGH", "T1190"),
    "rdp": ((3389,), "HIGH", "T1021.001"),
    "redis": ((6379,), "HIGH", "T1190"),
    "smb": ((139, 445), "HIGH", "T1021.002"),
    "ssh": ((22,), "MEDIUM", "T1021.004"),
    "vnc": (tuple(range(5900, 5904)), "MEDIUM", "T1021.005"),
    "winrm": ((5985, 5986), "MEDIUM", "T1021.006"),
}
#: Services that a host inside should not open a connection to outside, or anywhere but to itself.
LEAVING = {
    "smb": ((139, 445), "public", "HIGH", "T1187"),
    "telnet": ((23,), "not loopback", "MEDIUM", "T1021"),
}
#: Services by the names under which they are documented: severity, technique, and whether lookups, greetings or both count.
NAMED = {
    "address-echo": (("api.my-ip.io", "checkip.dyndns.org", "icanhazip.com", "ifconfig.co", "ipify.org", "wtfismyip.com"), "LOW", "T1016", "lookup"),
    "dynamic-dns": (("dedyn.io", "duckdns.org", "dyndns.org", "freedns.afraid.org", "noip.com", "ydns.eu"), "LOW", "T1568", "lookup"),
    "mining-pool": (("f2pool.com", "hashvault.pro", "herominers.com", "nanopool.org", "slushpool.com", "unmineable.com"), "MEDIUM", "T1496", "both"),
    "onion": (("onion",), "MEDIUM", "T1090.003", "lookup"),
    "paste": (("dpaste.org", "hastebin.com", "ix.io", "pastebin.com", "rentry.co", "termbin.com"), "LOW", "T1102", "greeting"),
    "robot-chat": (("api.telegram.org", "gateway.discord.gg"), "MEDIUM", "T1102.002", "greeting"),
    "tunnel": (("bore.pub", "ngrok.io", "ngrok-free.app", "pinggy.io", "playit.gg", "trycloudflare.com"), "MEDIUM", "T1572", "both"),
}
#: Advisories whose attack shows in the target of a request: by CVE number, what the documents give as its mark.
TARGETS = {
    "CVE-2017-9841": (r"/phpunit/(?:src/)?Util/PHP/eval-stdin", "CRITICAL"),
    "CVE-2018-10561": (r"/GponForm/diag_Form", "HIGH"),
    "CVE-2018-13379": (r"/remote/fgt_lang\?lang=.*\.\./", "HIGH"),
    "CVE-2019-11510": (r"/dana-na/.*\.\./", "HIGH"),
    "CVE-2019-19781": (r"/vpn/\.\./vpns/", "CRITICAL"),
    "CVE-2020-5902": (r"/tmui/login\.jsp/\.\.;/", "CRITICAL"),
    "CVE-2021-3129": (r"/_ignition/execute-solution", "HIGH"),
    "CVE-2021-41773": (r"/cgi-bin/(?:\.%2e|%2e%2e|%%32%65)/", "CRITICAL"),
    "CVE-2022-1388": (r"/mgmt/tm/util/bash", "CRITICAL"),
    "CVE-2022-26134": (r"/(?:\$|%24)(?:\{|%7b).*(?:\}|%7d)/?$", "CRITICAL"),
}
#: The same for what stands anywhere in a payload.
MARKS = {
    "CVE-2014-6271": (r"\(\)[\x20\t]*\{[^}]{0,8};[\x20\t]*\}[\x20\t]*;", "CRITICAL"),
    "CVE-2021-44228": (r"\$\{(?:jndi|(?:\$\{[^{}]{0,16}\}|[a-z]){1,12}):(?:ldaps?|rmi|dns|iiop)?", "CRITICAL"),
    "CVE-2022-22965": (r"class\.module\.classLoader\.resources|class\.module\.classLoader\.[A-Za-z]", "CRITICAL"),
}
#: Files that hold secrets of a server, as their own documentation names them.
SECRET_FILES = ("/.aws/credentials", "/.docker/config.json", "/.env", "/.git/config", "/.htpasswd", "/.kube/config", "/.npmrc", "/.ssh/id_", "/etc/passwd", "/etc/shadow", "/proc/self/environ", "/web.config")
#: Protocols whose passwords go in the clear (RFC 959, 1939, 3501, 4954): ports, and the command that carries one.
CLEAR_LOGINS = {
    "ftp": ((21,), r"^PASS (?!anonymous|ftp\r)[^\r\n@]+\r"),
    "imap": ((143,), r"^\S{1,16} (?:LOGIN \S+ \S|AUTHENTICATE (?:PLAIN|LOGIN))"),
    "pop3": ((110,), r"^(?:PASS [^\r\n]|APOP \S+ \S)"),
    "smtp": ((25, 587), r"^AUTH (?:PLAIN|LOGIN)(?:\s|$)"),
}
#: Headers of a request: header, pattern, severity, technique.
HEADERS = {
    "basic-login": ("authorization", r"^Basic [A-Za-z0-9+/]{4}", "MEDIUM", "T1552"),
    "house-login": ("authorization", r"^(?:NTLM|Negotiate) TlRMTVNTUA", "HIGH", "T1187"),
    "scripted-fetch": ("user-agent", r"\b(?:WindowsPowerShell|CertUtil|BITS|mshta|wscript)\b", "MEDIUM", "T1105"),
    "retired-browser": ("user-agent", r"\bMSIE [1-9]\.|\bNetscape[46]?/", "LOW", "T1071.001"),
}
#: What shells and scripts look like on the wire: their own syntax.
SHELLS = {
    "bash-socket": (r"/dev/(?:tcp|udp)/[^/\s]{1,255}/[0-9]{1,5}", "CRITICAL", "T1059.004"),
    "netcat-exec": (r"\b(?:nc|ncat|netcat)\b[^\r\n|;]{0,80}\s(?:-[a-z]*[ec]|--(?:sh-)?exec)\s+\S*(?:sh|cmd)", "CRITICAL", "T1059.004"),
    "python-socket": (r"socket\.socket\([^\r\n]{0,400}(?:dup2|pty\.spawn|subprocess)|import\s[^\r\n;]{0,40}\bsocket\b[^\r\n;]{0,40}\b(?:subprocess|pty)\b", "CRITICAL", "T1059.006"),
    "powershell-fetch": (r"(?:Net\.WebClient|Invoke-WebRequest|\biwr\b)[^\r\n]{0,200}|\.Download(?:String|File|Data)\(", "HIGH", "T1059.001"),
    "powershell-encoded": (r"\bpowershell[^\r\n]{0,100}\s-e[a-z]{0,13}\s+[A-Za-z0-9+/]{24}", "HIGH", "T1059.001"),
    "cmd-prompt": (r"Microsoft Windows \[Version \d+\.\d", "HIGH", "T1059.003"),
    "id-of-root": (r"\buid=0\([a-z]+\)\sgid=\d+\(", "HIGH", "T1059.004"),
    "psexec": (r"P\x00?S\x00?E\x00?X\x00?E\x00?S\x00?V\x00?C", "HIGH", "T1569.002"),
}
#: Protocols told by their first bytes or their own words, and what makes them worth a look: transport, ports (or not these),
#: pattern, severity, technique.
SPOKEN = {
    "irc": ("tcp", None, r"^(?:NICK|USER|JOIN|PRIVMSG) \S", "MEDIUM", "T1071"),
    "memcached-reflection": ("udp", (11211,), r"^[\x00-\xff]{8}(?:stats|gets?)\b", "HIGH", "T1498.002"),
    "ntp-monlist": ("udp", (123,), r"^[\x17\x97\x1f]\x00[\x02\x03]\x2a", "HIGH", "T1498.002"),
    "smb1": ("tcp", (139, 445), r"\xffSMB[\x00-\xff]", "MEDIUM", "T1210"),
    "ssh1": ("tcp", None, r"^SSH-1\.(?!99)\d", "MEDIUM", "T1021.004"),
    "ssh-elsewhere": ("tcp", "not 22", r"^SSH-2\.0-", "LOW", "T1571"),
    "stratum": ("tcp", None, r"\"method\"\s*:\s*\"(?:mining\.|eth_submit|login\")", "HIGH", "T1496"),
    "tftp": ("udp", (69,), r"^\x00[\x01\x02][\x01-\xff]+\x00(?i:octet|netascii|mail)\x00", "LOW", "T1105"),
}
#: What counts by its rate: match, (count, seconds, by), severity, technique.
RATES: dict[str, tuple[list[Any], tuple[int, int, str], str, str]] = {
    "any-lookups": ([{"dns.query_type": "ANY", "dns.is_response": False}], (10, 20, "src_ip"), "MEDIUM", "T1498.002"),
    "big-pings": ([{"field": "protocol", "op": "in", "value": ["icmp", "icmpv6"]}, {"field": "payload_len", "op": "gt", "value": 256}], (20, 60, "pair"), "MEDIUM", "T1095"),
    "christmas-packets": ([{"tcp.xmas": True, "tcp.ack": False, "tcp.syn": False}], (3, 20, "src_ip"), "MEDIUM", "T1046"),
    "default-community": ([{"protocol": "udp", "dst_port": 161}, {"field": "payload", "op": "regex", "value": r"\x04[\x06\x07](?:public|private)"}], (5, 60, "src_ip"), "LOW", "T1602.001"),
    "empty-packets": ([{"tcp.null": True, "payload_len": 0}, {"field": "src_scope", "op": "ne", "value": "loopback"}], (5, 20, "src_ip"), "MEDIUM", "T1046"),
    "nameless-greetings": ([{"field": "tls.ja3", "op": "exists"}, {"field": "tls.sni", "op": "exists", "value": False}, {"field": "tls.ech", "op": "ne", "value": True}, {"dst_scope": "public"}], (6, 600, "pair"), "LOW", "T1573"),
    "old-encryption": ([{"field": "tls.tls_version", "op": "in", "value": ["SSL 3.0", "TLS 1.0", "TLS 1.1"]}], (3, 300, "pair"), "LOW", "T1040"),
    "open-questions": ([{"protocol": "udp"}, {"field": "dst_port", "op": "in", "value": [137, 5355]}, {"field": "src_scope", "op": "ne", "value": "loopback"}], (40, 60, "src_ip"), "LOW", "T1557.001"),
    "text-lookups": ([{"dns.query_type": "TXT", "dns.is_response": False}, {"not": {"field": "dns.query_name", "op": "regex", "value": r"(?:^|\.)_|\.arpa\.?$"}}], (25, 60, "src_ip"), "MEDIUM", "T1048.003"),
}


def _rule(name: str, severity: str, technique: str, description: str, *match: Any, rate: tuple[int, int, str] | None = None) -> dict:
    out: dict[str, Any] = {"id": name, "severity": severity, "technique": technique, "description": description, "match": {"all": list(match)}, "message": description + ": {src_ip} to {dst_ip}:{dst_port}"}
    return out | ({"threshold": dict(zip(("count", "seconds", "track_by"), rate, strict=True))} if rate else {})


def _is(field: str, op: str, value: Any) -> dict:
    return {"field": field, "op": op, "value": value}


def _opened() -> list[dict]:
    """Connections that are opened (a SYN without ACK) across the border of the network."""
    syn = {"tcp.syn": True, "tcp.ack": False}
    out = [_rule(f"OPEN-IN-{n}", s, t, f"{n} opened from the Internet", syn, _is("dst_port", "in", list(p)), {"src_scope": "public"}, _is("dst_scope", "ne", "public")) for n, (p, s, t) in EXPOSED.items()]
    far = {"public": [{"dst_scope": "public"}, _is("src_scope", "ne", "public")], "not loopback": [_is("dst_scope", "ne", "loopback")]}
    return out + [_rule(f"OPEN-OUT-{n}", s, t, f"{n} opened to another network", syn, _is("dst_port", "in", list(p)), *far[where]) for n, (p, where, s, t) in LEAVING.items()]


def _names() -> list[dict]:
    """Names of services, and names under them, and two kinds of lookups that say something of themselves."""
    out = []
    for name, (domains, severity, technique, where) in NAMED.items():
        under = r"(?:^|\.)(?:" + "|".join(map(re.escape, domains)) + r")\.?$"
        ways = {"lookup": {"all": [_is("dns.query_name", "regex", under), {"dns.is_response": False}]}, "greeting": _is("tls.sni", "regex", under)}
        out.append(_rule(f"NAME-{name}", severity, technique, f"a name of the kind {name}", {"any": list(ways.values())} if where == "both" else ways[where]))
    cheap = r"\.(?:cf|cyou|ga|gq|icu|ml|mov|rest|sbs|tk|top|zip)\.?$"
    out.append(_rule("NAME-cheap-zone", "LOW", "T1071.004", "a lookup under a zone that abuse reports lead", {"dns.is_response": False}, _is("dns.query_name", "regex", cheap)))
    out.append(_rule("NAME-null-record", "HIGH", "T1071.004", "a lookup of a record that RFC 1035 calls experimental", {"dns.query_type": "NULL", "dns.is_response": False}))
    return out


def _requests() -> list[dict]:
    asks, uri = {"http.direction": "request"}, "http.uri"
    out = [_rule(cve, severity, "T1190", f"a request as {cve} describes it", asks, _is(uri, "regex", pattern)) for cve, (pattern, severity) in TARGETS.items()]
    out += [_rule(cve, severity, "T1190", f"a payload as {cve} describes it", {"protocol": "tcp"}, _is("payload", "regex", pattern)) for cve, (pattern, severity) in MARKS.items()]
    out += [_rule(f"HEADER-{n}", s, t, f"a header that tells of {n}", asks, _is(f"http.headers.{header}", "regex", pattern), _is("dst_scope", "ne", "loopback")) for n, (header, pattern, s, t) in HEADERS.items()]
    out.append(_rule("REQUEST-secret-file", "MEDIUM", "T1595.003", "a request for a file with secrets", asks, _is(uri, "contains", list(SECRET_FILES))))
    command = r"(?:[;|&`]|%3b|%7c|%26|%60|\$(?:\(|%28))(?:\s|\+|%20)*(?:/\S*/)?(?:ba|da|z)?(?:sh|busybox|curl|fetch|perl|php|powershell|python\d?|tftp|wget)(?:\s|\+|%20)"
    out.append(_rule("REQUEST-command", "HIGH", "T1059", "a request that carries a command", asks, _is(uri, "regex", command)))
    out.append(_rule("REQUEST-password", "MEDIUM", "T1552", "a form with a password without encryption", asks, {"http.method": "POST"}, _is("http.body", "regex", r"(?:^|&)(?:passphrase|passwd|password|pass|pwd)=[^&]")))
    program = r"\.(?:apk|bat|deb|dll|elf|exe|hta|jar|js|msi|pkg|ps1|rpm|scr|sh|vbs)(?:[?#]|$)"
    out.append(_rule("REQUEST-program-by-number", "HIGH", "T1105", "a program fetched from an address without a name", asks, {"dst_scope": "public"}, _is("http.host", "regex", r"^(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?$"), _is(uri, "regex", program)))
    out.append(_rule("ANSWER-program", "MEDIUM", "T1105", "a program sent without encryption", {"http.direction": "response", "src_scope": "public"}, _is("http.body", "regex", r"^(?:MZ[\x00-\xff]{60,}PE\x00\x00|\x7fELF[\x01\x02][\x01\x02]|\xcf\xfa\xed\xfe)")))
    return out


def _payloads() -> list[dict]:
    out = [_rule(f"LOGIN-{n}", "MEDIUM", "T1552", f"a password in the clear over {n}", {"protocol": "tcp"}, _is("dst_port", "in", list(ports)), _is("payload", "regex", pattern)) for n, (ports, pattern) in CLEAR_LOGINS.items()]
    out += [_rule(f"SHELL-{n}", s, t, f"on the wire: {n}", {"protocol": "tcp"}, _is("payload", "regex", pattern)) for n, (pattern, s, t) in SHELLS.items()]
    for n, (transport, ports, pattern, s, t) in SPOKEN.items():
        where = [] if ports is None else [_is("dst_port", "not_in", [22]), _is("src_port", "not_in", [22])] if ports == "not 22" else [_is("dst_port", "in", list(ports))]
        out.append(_rule(f"SPEAKS-{n}", s, t, f"a packet of {n}", {"protocol": transport}, *where, _is("payload", "regex", pattern)))
    return out


def _rates() -> list[dict]:
    return [_rule(f"RATE-{n}", severity, technique, f"many {n.replace('-', ' ')}", *match, rate=rate) for n, (match, rate, severity, technique) in RATES.items()]


RULES = [*_opened(), *_names(), *_requests(), *_payloads(), *_rates()]

"""What an alert means, in plain words: a verdict, what happened, and what to do; and times and sizes as people say them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By tag, the first that an alert has: verdict (act, check, know, fine), what it means, what to do.
BY_TAG = (
    ("likely_c2", "act", "Several signs together speak for a program that takes orders from outside.", "Disconnect the host and look at the program first."),
    ("threat_intel", "act", "The other side is on a list of known bad addresses or names.", "Find out which program talks to it and stop it."),
    ("brute_force", "act", "Someone keeps trying to log in.", "Close the port to the outside and check for a login that worked."),
    ("exfiltration", "check", "A lot of data left for one place.", "Ask whether a backup or an upload explains it."),
    ("beaconing", "check", "A program calls the same place at even intervals.", "Look up the place; updates and chat do this too."),
    ("dga", "check", "Many names that do not exist were looked up.", "Look for a program that makes names up."),
    ("dns_tunneling", "check", "Names carry what looks like data.", "See which program asks for them."),
    ("sqli", "act", "A request tries to get at a database.", "Check what the server answered."),
    ("xss", "check", "A request carries a script.", "Check whether the page shows it to others."),
    ("path_traversal", "act", "A request tries to leave the server's folder.", "Check what the server answered."),
    ("scanner", "know", "A tool that looks for weak spots was used.", "Nothing, if it is yours."),
    ("vertical_scan", "check", "One host tried many ports of another.", "Nothing, if it is yours; else block it."),
    ("host_sweep", "check", "One host tried the same port of many others.", "Look at that host for a worm."),
    ("volumetric", "check", "One source sends far more than it used to.", "See whether a transfer explains it."),
    ("localhost_scan", "act", "A page tried many ports of this computer.", "Close the page."),
    ("localhost_probe", "check", "A page talked to a service of this computer.", "Nothing, if you use that service with it."),
    ("webrtc", "know", "A call or a page asked for this computer's addresses.", "Nothing during a call."),
    ("doh", "know", "Names are looked up where this tool cannot see them.", "Nothing, if the browser is set so."),
    ("tracker", "know", "A page reported to a company that follows readers.", "A blocker in the browser stops it."),
    ("new_program", "know", "A program used the network for the first time.", "Nothing, if you installed it."),
    ("new_device", "check", "A device joined the network for the first time.", "Nothing, if it is yours or a guest's."),
    ("host_risk", "check", "A program from an odd place, or without a signature, uses the network.", "Find out where it came from."),
    ("correlation", "act", "One source set off several kinds of alerts.", "Look at its alerts in order."),
)
BY_KIND = {"threat": "act", "attack": "check", "localhost": "check", "host": "check", "beacon": "know", "quic": "fine", "websocket": "fine", "prefetch": "fine", "tracker": "know", "doh": "know", "webrtc": "know"}


def guide(tags: Column, kind: Column) -> Column:
    """verdict, meaning and advice of an alert, by its tags or else its kind."""
    shape = lambda v, m, a: F.struct(v.alias("verdict"), F.lit(m).alias("meaning"), F.lit(a).alias("advice"))
    out = None
    for tag, verdict, meaning, advice in BY_TAG:
        here = F.coalesce(F.array_contains(tags, tag), F.lit(False))
        out = F.when(here, shape(F.lit(verdict), meaning, advice)) if out is None else out.when(here, shape(F.lit(verdict), meaning, advice))
    by_kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BY_KIND.items() for x in kv)), kind), F.lit("know"))
    return out.otherwise(shape(by_kind, "Something that this tool watches for was seen.", "Read the alert's message."))


def interval(us: Column) -> Column:
    """A time as people say it: 5 s, 10 min, 3 h, 2 d; halves go to the even number."""
    s = us / 1e6
    units = ((90.0, 1.0, "s"), (5400.0, 60.0, "min"), (129_600.0, 3600.0, "h"))
    out = None
    for below, size, unit in units:
        text = F.concat(F.bround(s / size).cast("long").cast("string"), F.lit(" " + unit))
        out = F.when(s < below, text) if out is None else out.when(s < below, text)
    return out.otherwise(F.concat(F.bround(s / 86_400.0).cast("long").cast("string"), F.lit(" d")))


def size(n: Column) -> Column:
    """A number of bytes as people say it: 17 B, 1.5 KB, 3.0 MB, 2.0 GB."""
    out = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1000 ** (power + 1), F.concat(F.bround(n / 1000**power, 1).cast("decimal(20,1)").cast("string"), F.lit(" " + unit)))
    return out.otherwise(F.concat(F.bround(n / 1e9, 1).cast("decimal(20,1)").cast("string"), F.lit(" GB")))

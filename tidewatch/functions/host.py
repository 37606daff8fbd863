"""Programs, signatures, hardware addresses and exposure of a host, as columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ip

#: What a path is that begins so, ~/ being the home of any user: system, tool (packages that are often not signed), or why
#: a program there is odd. The longest beginning counts. Places are those of the file system's documentation (hier(7) and
#: the File System Programming Guide) and the roots that package managers document.
PLACES = {
    "/Library/Caches/": "a cache",
    "/Library/Developer/": "tool",
    "/System/": "system",
    "/Users/Shared/": "the folder that users share",
    "/Volumes/": "a mounted disk",
    "/bin/": "system",
    "/nix/": "tool",
    "/opt/": "tool",
    "/sbin/": "system",
    "/tmp/": "a temporary folder",
    "/usr/bin/": "system",
    "/usr/libexec/": "system",
    "/usr/local/": "tool",
    "/usr/sbin/": "system",
    "/var/folders/": "a user's temporary folder",
    "/var/tmp/": "a temporary folder",
    "~/Downloads/": "the downloads",
    "~/Library/Application Support/": "application data without a bundle",
    "~/Library/Caches/": "a cache",
    "~/Library/Containers/": "the data of another program",
    "~/Library/LaunchAgents/": "the folder of launch items",
}
#: Places that are odd only outside of an application bundle.
UNLESS_BUNDLED = ("a mounted disk", "application data without a bundle")
#: Tools of one user lie under a hidden folder of the home, in folders that are named as those of the system's tools.
OWN_TOOL = r"^~/\.[^/]+/(?:.*/)?(?:bin|sbin|libexec|lib|shims|node_modules)/"
#: Risk by kind of place and of signature: 0 nothing, 1 unusual, 2 suspicious, 3 very suspicious.
RISK = {
    "odd": {"trusted": 1, "unknown": 2, "unsigned": 3, "adhoc": 3, "invalid": 3},
    "tool": {"trusted": 0, "unknown": 0, "unsigned": 0, "adhoc": 0, "invalid": 3},
    "plain": {"trusted": 0, "unknown": 0, "unsigned": 1, "adhoc": 1, "invalid": 3},
}
#: What statuses of a signature count as; others are unknown.
SIGNATURES = {"adhoc": "adhoc", "app_store": "trusted", "apple": "trusted", "developer_id": "trusted", "invalid": "invalid", "unsigned": "unsigned"}


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _at_home(exe: Column) -> Column:
    """A path without the link that leads to /private, and with ~ for a user's home."""
    return F.regexp_replace(F.regexp_replace(exe, r"^/private/", "/"), r"^/Users/(?!Shared/)[^/]+/", "~/")


def place(exe: Column) -> Column:
    """The entry of PLACES with the longest beginning, or null; tool for a tool of one user."""
    starts = "|".join(re.escape(p) for p in sorted(PLACES, key=len, reverse=True))
    of = lambda path: F.when(path.rlike(OWN_TOOL), "tool").otherwise(_lookup(PLACES, F.regexp_extract(path, f"^(?:{starts})", 0)))
    return _once(_at_home(exe), of)


def is_tool(exe: Column) -> Column:
    """Whether a program lies where tools of packages or of a user do."""
    return F.coalesce(place(exe) == "tool", F.lit(False))


def is_system(exe: Column) -> Column:
    return F.coalesce(place(exe) == "system", F.lit(False))


def _odd(exe: Column, where: Column) -> Column:
    named = F.when(~where.isin("system", "tool") & ~(where.isin(*UNLESS_BUNDLED) & F.contains(exe, F.lit(".app/"))), where)
    hidden = F.when(exe.rlike(r"/\.[^/]*$"), "a hidden file").when(exe.rlike(r"/\.[^/]+/"), "a hidden folder")
    return F.when(~F.contains(exe, F.lit("/AppTranslocation/")) & (F.coalesce(where, F.lit("")) != "tool"), F.coalesce(named, hidden))


def odd_place(exe: Column) -> Column:
    """Why the place of a program is odd, or null. Copies that the system quarantines are not."""
    return _once(place(exe), lambda where: _odd(exe, where))


def assess(exe: Column, status: Column) -> Column:
    """flags, risk (see RISK) and the place's reason, from place and signature."""
    signed = F.coalesce(_lookup(SIGNATURES, F.coalesce(status, F.lit(""))), F.lit("unknown"))
    kind = lambda x: F.when(x["odd"].isNotNull(), "odd").when(x["where"] == "tool", "tool").otherwise("plain")
    flag = lambda x: F.when(x["signed"] == "invalid", "invalid_signature").when(x["signed"].isin("unsigned", "adhoc"), x["signed"])
    risks = {f"{k} {s}": n for k, row in RISK.items() for s, n in row.items()}

    def said(x: Column) -> Column:
        flags = F.array_compact(F.array(F.when(x["odd"].isNotNull(), "odd_path"), flag(x)))
        return F.struct(flags.alias("flags"), _lookup(risks, F.concat_ws(" ", kind(x), x["signed"])).alias("risk"), x["odd"].alias("place"))

    return _once(_once(F.struct(place(exe).alias("where"), signed.alias("signed")), lambda x: F.struct(x["where"].alias("where"), x["signed"].alias("signed"), _odd(exe, x["where"]).alias("odd"))), said)


def _starts(text: Column, beginnings: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(or_, map(text.startswith, beginnings)), F.lit(False))


def bundle(exe: Column) -> Column:
    """The outermost application bundle that holds a program, or null."""
    found = F.regexp_extract(exe, r"^(.*?\.app)/", 1)
    return F.when(found != "", found)


def app_name(exe: Column) -> Column:
    """The name of a program's outermost bundle, or else that of its file; null for null."""
    own = F.regexp_extract(bundle(exe), r"([^/]+)\.app$", 1)
    return F.coalesce(F.when(own != "", own), F.substring_index(exe, "/", -1))


def scope(address: Column) -> Column:
    """none, unknown, loopback, internet or lan, as an inspector shows a remote address."""
    kind = ip.classify(F.regexp_replace(address, "%.*$", ""))
    return F.when(address.isNull() | (address == ""), "none").when(kind == "unknown", "unknown").when(kind == "loopback", "loopback").when(ip.is_global(address), "internet").otherwise("lan")


EXPOSURES = ("unknown", "this_mac", "link_local", "lan", "all_networks")


def exposure(local: Column) -> Column:
    """From where a listener on a local address can be reached: one of EXPOSURES."""
    kind = ip.classify(F.regexp_replace(local, "%.*$", ""))
    return F.when(local.isin("0.0.0.0", "::", "*", ""), "all_networks").when(kind == "loopback", "this_mac").when(kind == "link_local", "link_local").when(kind == "unknown", "unknown").otherwise("lan")


def exposure_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EXPOSURES)), name).cast("int") - 1


def mac(text: Column) -> Column:
    """A hardware address in lower case with two digits a part."""
    return F.array_join(F.transform(F.split(F.lower(text), "[:-]"), lambda p: F.lpad(p, 2, "0")), ":")


def is_random_mac(address: Column) -> Column:
    """Whether a hardware address was made up locally: the second-lowest bit of its first byte."""
    return F.coalesce(F.conv(F.substring(address, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(2)) != 0, F.lit(False))


#: Programs that browse, for the two tests that ask for them: fixed names.
BROWSERS = ("Safari", "Google Chrome", "Firefox", "Microsoft Edge", "Brave Browser", "Arc", "Opera", "Vivaldi", "Chromium")


def is_browser(app: Column, prefixes: tuple[str, ...] = ("com.apple.WebKit", "Safari")) -> Column:
    """Whether an app is a browser; the probe of local ports also takes helpers by the beginning of their name."""
    return F.coalesce(app.isin(*BROWSERS) | _starts(app, prefixes) if prefixes else app.isin(*BROWSERS), F.lit(False))

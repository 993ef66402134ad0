"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "fbclid gclid dclid msclkid twclid igshid mc_cid mc_eid ref referer referrer source src from spm scm ncid cmpid campaign ito smid sref share_token "
    "share_source wt_mc wt_zmc at_medium at_campaign at_custom1 at_custom2 at_custom3 at_custom4 cid s taid traffic_source xtor guccounter guce_referrer "
    "guce_referrer_sig _hsenc _hsmi vero_id yclid rss partner sh"
).split()
TRACKING_PREFIX = r"^(utm_|pk_|mtm_)"
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(u: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(u), PARTS, i)


def domain(u: Column) -> Column:
    """Host in lower case without credentials and port; empty when there is none."""
    return F.regexp_replace(F.lower(F.regexp_replace(part(u, 2), "^.*@", "")), r":\d*$", "")


def base_domain(u: Column) -> Column:
    return F.regexp_replace(domain(u), r"^www\.", "")


def is_tracking(key: Column) -> Column:
    return F.lower(key).rlike(TRACKING_PREFIX) | F.lower(key).isin(TRACKING)


def normalize_url(u: Column) -> Column:
    """Key form: no fragment, credentials, default port or tracking parameters; parameters sorted; no trailing slash."""
    scheme = F.lower(part(u, 1))
    port = F.regexp_extract(part(u, 2), r":(\d+)$", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(part(u, 3) == "", "/").otherwise(part(u, 3))
    pairs = F.filter(F.split(part(u, 4), "&"), lambda p: p != "")
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))), lambda x: ~is_tracking(x["k"]))
    query = F.array_join(F.transform(F.array_sort(kept), lambda x: x["p"]), "&")
    path = F.when((query == "") & (path != "/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    made = F.concat(scheme, F.lit("://"), domain(u), shown, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(u, 1) == "", F.trim(u).substr(1, 500)).otherwise(made)


def public_url_problem(u: Column) -> Column:
    """Why a url must not be fetched; null when it may be."""
    host, port = domain(u), F.regexp_extract(part(u, 2), r":(\d+)$", 1)
    private = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\.")
    return (
        F.when(~F.lower(part(u, 1)).isin("http", "https"), "scheme").when(part(u, 2).contains("@"), "credentials").when(host == "", "host")
        .when(host.rlike(r"(^|\.)(localhost|local|internal)$"), "local").when(private, "private").when(~port.isin("", "80", "443", "8080", "8443"), "port")
    )


#: Publishers whose texts are for subscribers.
PAYWALLS = "ft.com wsj.com economist.com bloomberg.com nytimes.com washingtonpost.com caixin.com theinformation.com barrons.com telegraph.co.uk lemonde.fr haaretz.com nikkei.com".split()


def is_paywalled(u: Column) -> Column:
    return domain(u).rlike("(^|\\.)(" + "|".join(p.replace(".", "\\.") for p in PAYWALLS) + ")$")


#: Scheme, user, host, port, path, query and fragment of an absolute web address.
WEB = r"^\s*([hH][tT][tT][pP][sS]?)://([^/?#@\s]*@)?([^/?#:@\s]+)(:[0-9]*)?([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$"


def safe_external(u: Column) -> Column:
    """A web address as a link may hold it: scheme and host in lower case, no usual port, a path; null for anything else."""
    p = [F.regexp_extract(u, WEB, i) for i in range(8)]
    scheme, port = F.lower(p[1]), F.regexp_replace(p[4], "^:", "")
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    made = F.concat(scheme, F.lit("://"), p[2], F.lower(p[3]), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(p[5] == "", "/").otherwise(p[5]), p[6], p[7])
    return F.when(p[3] != "", made)


def shown_host(u: Column, otherwise: str = "link") -> Column:
    """The host that is shown for a link, without www; ``otherwise`` where the address is no safe one."""
    return F.when(safe_external(u).isNull(), otherwise).otherwise(F.regexp_replace(F.lower(F.regexp_extract(u, WEB, 3)), r"^www\.", ""))

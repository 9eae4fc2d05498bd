"""Addresses as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that identify a session or a referrer, not a page. All that begin with utm_ go too.
DROPPED_PARAMETERS = "apitoken auth authorization iauid jobboardsource session sessionid token".split()

_FORM = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, port, path, and the kept parameters sorted by folded name and value; empty texts for a text that is no address."""
    text = F.trim(url)
    part = lambda i: F.regexp_extract(text, _FORM, i)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(DROPPED_PARAMETERS))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(name(p).alias("n"), F.substring(p, F.length(name(p)) + 2, F.length(p)).alias("v"), p.alias("p")))), lambda s: s["p"])
    return {"scheme": F.lower(part(1)), "host": F.lower(part(2)), "port": part(3), "path": part(4), "parameters": ordered}


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no tracking or secret parameters, the others sorted, no fragment, no
    trailing slash. A null or empty text gives an empty text; one that names no host comes back trimmed."""
    p = url_parts(url)
    default = ((p["scheme"] == "https") & (p["port"] == "443")) | ((p["scheme"] == "http") & (p["port"] == "80")) | (p["port"] == "")
    path = F.regexp_replace(p["path"], "/+$", "")
    full = F.concat(
        p["scheme"], F.lit("://"), p["host"], F.when(default, "").otherwise(F.concat(F.lit(":"), p["port"])),
        F.when(path == "", "/").otherwise(path), F.when(F.size(p["parameters"]) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(p["parameters"], "&"))),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(p["host"] == "", F.trim(url)).otherwise(full)

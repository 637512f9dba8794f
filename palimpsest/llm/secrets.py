r"""Secrets in texts, with multipart credentials linked across a scope.

Base kinds are reported wherever they are: ``assign`` (a telling name, a sign and a value
of 8 or more characters), ``access`` (an access identifier) and ``hex`` (32 or more hex
digits).  Weak candidates are reported only where complementary parts are in the same
scope: two parts share one if at most ``REACH`` code points lie between them, whichever of
them comes first and however long they are.

* ``secret``, a run of 40 or more base64 characters with both cases and a digit: near an
  identifier (``access`` or ``id``);
* ``id``, an account name that is assigned: near a secret (``assign`` or ``secret``);
* ``endpoint``, a URL's scheme and host: near an identifier and a secret.

Each secret near an identifier is a linked credential: it is reported with the nearest
identifier and, if there is one near the secret, the nearest endpoint.

Only DataFrame operations run.  A text is split at the matches of each pattern, and
running sums of the lengths give positions; a pattern is only tried on texts that have its
fixed pieces.  Parts are interval-joined by id, text hash and cell of ``REACH`` code points, a
pair in the first cell that both sides share.  Parts of a pattern do not overlap, so a part has
a bounded number of others within reach.

Defined results: a null or empty text has no spans; equal rows are judged alike; offsets
are code points, ends exclusive; patterns match ASCII letters only.  An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import apart
from .scratch import table

REACH = 200
_NAMED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns by kind, in the order of kinds at equal starts; the third is what a match must also be like.
PATTERNS = (
    ("assign", f"(?i){_NAMED}", f"(?i)^{_NAMED.replace('+)', '{8,})')}$"),
    ("access", r"AKIA[A-Z0-9]{12,}", None),
    ("hex", r"[0-9a-f]{32,}", None),
    ("secret", r"[A-Za-z0-9+/]{40,}", None),
    ("id", r"(?i)(client_?id|account|user(name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", None),
    ("endpoint", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(:[0-9]{1,5})?", None),
)
BASE = ("assign", "access", "hex")
IDS, SECRETS = ("access", "id"), ("assign", "secret")


def _possible(name: str, text: Column, low: Column, run: Column) -> Column:
    """Whether a text has what any match of a pattern needs; ``low`` is it in lower case, and
    ``run`` whether it has 32 base64 characters in a row."""
    any_ = lambda *words: reduce(or_, (low.contains(w) for w in words))
    sign = text.contains(":") | text.contains("=")
    return {
        "assign": sign & any_("passw", "secret", "token", "api"), "access": text.contains("AKIA"), "hex": run, "secret": run,
        "id": sign & any_("client", "account", "user", "login"), "endpoint": text.contains("://"),
    }[name]


def _parts(text: Column, low: Column, run: Column) -> Column:
    """An array of (kind, i, gap, match): the matches of each pattern with the length before them."""
    out = []
    for k, (name, pattern, _) in enumerate(PATTERNS):
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
        kind = F.lit(k).alias("kind")
        each = F.transform(zipped, lambda x, i: F.struct(kind, i.alias("i"), F.length(x["g"]).alias("gap"), x["m"].alias("match")))  # noqa: B023
        out.append(F.when(_possible(name, text, low, run) & text.rlike(pattern), F.filter(each, lambda x: x["match"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,match:string>>")))
    return F.concat(*out)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, kind, start, end) of every base part and weak candidate, once for equal rows."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.lower("text").alias("low"), F.col("text").rlike("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}").alias("run"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), F.explode(_parts(F.col("text"), F.col("low"), F.col("run"))).alias("p")).select("id", "hash", "p.*")
    fit = F.lit(True)
    for k, (name, _, full) in enumerate(PATTERNS):
        if full:
            fit = F.when(F.col("kind") == k, F.col("match").rlike(full)).otherwise(fit)
        if name == "secret":
            fit = F.when(F.col("kind") == k, F.col("match").rlike("[A-Z]") & F.col("match").rlike("[a-z]") & F.col("match").rlike("[0-9]")).otherwise(fit)
    rows = rows.select("id", "hash", "kind", "i", F.col("gap").cast("long").alias("gap"), F.length("match").cast("long").alias("len"), fit.alias("fit")).dropDuplicates(["id", "hash", "kind", "i"])
    so_far = Window.partitionBy("id", "hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).where("fit")
    return rows.select("id", "hash", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def near(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, hash, l, r, gap): pairs of parts of the same text with at most ``REACH`` code points
    between them; ``l`` and ``r`` are (start, kind, end)."""
    side = lambda df, c: df.select(F.col("id").alias(f"{c}_id"), F.col("hash").alias(f"{c}_hash"), F.struct("start", "kind", "end").alias(c))
    l, r = side(left, "l"), side(right, "r")  # noqa: E741
    l = l.withColumn("l_cell", F.explode(F.expr(f"sequence(l.start div {REACH}, l.end div {REACH})")))  # noqa: E741
    r = r.withColumn("r_cell", F.explode(F.expr(f"sequence(greatest(0L, r.start - {REACH}) div {REACH}, (r.end + {REACH}) div {REACH})")))
    same = F.col("l_id").eqNullSafe(F.col("r_id")) & (F.col("l_hash") == F.col("r_hash")) & (F.col("l_cell") == F.col("r_cell"))
    first = F.expr(f"l_cell = greatest(l.start div {REACH}, greatest(0L, r.start - {REACH}) div {REACH})")
    found = l.join(r, same).where(first & F.expr(f"l.start <= r.end + {REACH} and l.end >= r.start - {REACH}"))
    return found.select(F.col("l_id").alias("id"), F.col("l_hash").alias("hash"), "l", "r", F.expr("greatest(0L, r.start - l.end, l.start - r.end)").alias("gap"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``, (start, kind, end, name) by start, then kind, and
    ``secret_links``, (secret, identifier, endpoint) of spans, by secret."""
    return apart(docs, ("secret_spans", "secret_links"), (id_col, text_col), lambda d, own: _found(d, own(id_col), own(text_col)))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number = {name: k for k, (name, _, _) in enumerate(PATTERNS)}
    of = lambda df, names: df.where(F.col("kind").isin([number[n] for n in names]))
    found = table(parts(docs, id_col, text_col), "parts")
    linked = table(near(of(found, SECRETS), of(found, IDS)), "linked")
    ends = table(near(of(found, SECRETS), of(found, ["endpoint"])).join(near(of(found, ["endpoint"]), of(found, IDS)).select("id", "hash", F.col("l").alias("r")).distinct().withColumnsRenamed({"id": "_i", "hash": "_h", "r": "_r"}), F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h")) & (F.col("r") == F.col("_r")), "left_semi"), "ends")
    weak = linked.select("id", "hash", F.col("l").alias("s")).where(F.col("s.kind") == number["secret"]).union(linked.select("id", "hash", "r").where(F.col("r.kind") == number["id"])).union(ends.select("id", "hash", "r")).distinct()
    closest = lambda df, name: df.groupBy("id", "hash", "l").agg(F.min(F.struct("gap", F.col("r.start"), F.col("r.kind"), F.col("r"))).getField("r").alias(name))
    pair = closest(linked, "identifier").join(closest(ends, "endpoint").withColumnsRenamed({"id": "_i", "hash": "_h", "l": "_l"}), F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h")) & (F.col("l") == F.col("_l")), "left")
    names = F.array(*(F.lit(n) for n, _, _ in PATTERNS))
    named = lambda c: F.when(c.isNotNull(), F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.get(names, c["kind"]).alias("name")))
    base = of(found, BASE).select("id", "hash", F.struct("start", "kind", "end").alias("s"))
    link = F.struct(named(F.col("l")).alias("secret"), named(F.col("identifier")).alias("identifier"), named(F.col("endpoint")).alias("endpoint"))
    rows = base.union(weak).select("id", "hash", named(F.col("s")).alias("span")).unionByName(pair.select("id", "hash", link.alias("link")), allowMissingColumns=True)
    each = rows.groupBy(F.col("id").alias("_id"), F.col("hash").alias("_hash")).agg(*(F.array_sort(F.collect_list(c)).alias(f"secret_{c}s") for c in ("span", "link")))
    result = ("secret_spans", "secret_links")
    own = [c for c in docs.columns if c not in result]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mine = docs.select(*(f"`{c}`" for c in own), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash")).alias("_secret_key"))
    joined = mine.join(each, F.col("_secret_key.id").eqNullSafe(F.col("_id")) & (F.col("_secret_key.hash") == F.col("_hash")), "left")
    return joined.select(*(f"`{c}`" for c in own), *(F.coalesce(c, F.array().cast(each.schema[c].dataType)).alias(c) for c in result))


def link_digest(links: Column) -> Column:
    """secret+identifier(+endpoint) of each link, joined by commas."""
    one = lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])
    return F.array_join(F.transform(links, lambda x: F.concat_ws("+", one(x["secret"]), one(x["identifier"]), F.when(x["endpoint"].isNotNull(), one(x["endpoint"])))), ",")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")

"""Entity views: one row, its paginated collections, localised."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from starloom.catalog import Bridge, Catalog, Children, Entity, Neighbours, Properties, Siblings
from starloom.functions.text import video_urls
from starloom.operators.relational import Page, concatenated, first_by, neighbours, page_with_total, pivot_max, top_n


class NotFound(LookupError):
    """No such entity."""


class UnknownCollection(ValueError):
    """The entity has no collection of that name."""


@dataclass
class View:
    row: DataFrame
    collections: dict[str, DataFrame]


class Engine:
    """Catalogue-driven access to a set of tables."""

    def __init__(self, catalog: Catalog, read: Callable[[str], DataFrame]):
        self.catalog, self.read = catalog, read

    def rows(self, entity: Entity) -> DataFrame:
        return self.read(entity.table)

    def point(self, kind: str, value) -> DataFrame:
        e = self.catalog.entities[kind]
        return self.rows(e).where(F.col(e.id) == value).select(*e.columns).limit(1)

    def registry(self, kind: str, value) -> dict[str, Callable[[], tuple[DataFrame, list, list[str]]]]:
        """Lazy builders of all collections of one entity: (rows, order, columns)."""
        out = {}
        for link in self.catalog.links.values():
            if isinstance(link, Bridge):
                if kind in (link.left, link.right):
                    out[link.name] = lambda b=link: self._bridge(kind, value, b)
            elif link.entity == kind:
                build = {Neighbours: self._neighbours, Siblings: self._siblings, Children: self._children, Properties: self._properties}[type(link)]
                out[link.name] = lambda link=link, build=build: build(value, link)
        return out

    def _bridge(self, kind: str, value, b: Bridge):
        """Related entities over a bridge, in the edge's order."""
        mine, theirs, other = (b.left_key, b.right_key, b.right) if b.left == kind else (b.right_key, b.left_key, b.left)
        e = self.catalog.entities[other]
        edges = self.read(b.table).where(F.col(mine) == value)
        edges = edges.where(b.where) if b.where else edges
        sorts = [(s, f"_s{i}") for i, s in enumerate(b.sort)]
        per = edges.groupBy(F.col(theirs).alias("_id")).agg(F.count("*").alias("n_edges"), *[(F.max(s.column) if s.descending else F.min(s.column)).alias(a) for s, a in sorts])
        df = per.join(self.rows(e), F.col("_id") == F.col(e.id))
        order = [F.col(a).desc() if s.descending else F.col(a).asc_nulls_last() for s, a in sorts]
        return df, [*order, *e.order()], [*e.columns, "n_edges"]

    def _neighbours(self, value, link: Neighbours):
        e = self.catalog.entities[link.entity]
        edges = self.read(link.table).where(F.col(link.key) == value).select(F.col(link.other_key).alias("_id"), *[s.column for s in link.sort])
        return edges.join(self.rows(e), F.col("_id") == F.col(e.id)), [*(s.expr() for s in link.sort), F.col(e.id).asc()], [*e.columns, *(s.column for s in link.sort)]

    def _siblings(self, value, link: Siblings):
        e = self.catalog.entities[link.entity]
        same = self.rows(e).where(F.col(e.id) == value).select(F.col(link.by).alias("_by"))
        df = self.rows(e).where(F.col(e.id) != value).join(F.broadcast(same), F.col(link.by) == F.col("_by"))  # one row
        return df, e.order(), list(e.columns)

    def _children(self, value, link: Children):
        e = self.catalog.entities[link.other]
        df, names = self.rows(e).where(F.col(link.other_key) == value), list(e.columns)
        if link.rated:
            table, key, column, name = link.rated
            per = self.read(table).where(F.col(column).isNotNull()).join(df.select(F.col(e.id).alias(key)), key, "left_semi").groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(name), F.round(F.avg(column), 6).alias("rating"))
            df = df.join(per, F.col(e.id) == F.col("_k"), "left").withColumn(name, F.coalesce(name, F.lit(0)))
            names += [name, "rating"]
        special = [F.when(F.col(s.column) == 0, 1).otherwise(0).asc() for s in link.sort if s.column == "SEASON_NUMBER"]  # specials go last
        return df, [*special, *(s.expr() for s in link.sort), F.col(e.id).asc()], names

    def _properties(self, value, link: Properties):
        e = self.catalog.entities[link.other]
        t = self.read(link.table).where((F.col(link.item) == value) & F.col(link.property).isin(*link.properties)).select(F.col(link.key).alias("_id"), F.col(link.property).alias("_property"))
        # the text key of a triple against the entity's own: both as text, so that neither is cast to a number
        df = t.join(self.rows(e), F.col("_id").cast("string") == F.col(link.other_key).cast("string")).withColumnRenamed("_property", "ID_PROPERTY")
        return df, [*e.order(), F.col("ID_PROPERTY").asc()], [*e.columns, "ID_PROPERTY"]

    def collection(self, kind: str, value, name: str, page: Page = Page()) -> DataFrame:
        reg = self.registry(kind, value)
        if name not in reg:
            raise UnknownCollection(name)
        df, order, columns = reg[name]()
        return page_with_total(df, order, page).select(*columns, "total")

    def view(self, kind: str, value, collection: str | None = None, page: Page = Page()) -> View:
        """The row and all collections' first pages, or one collection's page; builders that aren't asked for never run."""
        row = self.point(kind, value)
        if row.isEmpty():
            raise NotFound(f"{kind} {value}")
        names = [collection] if collection else list(self.registry(kind, value))
        return View(row, {n: self.collection(kind, value, n, page if collection else Page(1, page.rows)) for n in names})

    def nested(self, kind: str, name: str, most: int = 12) -> DataFrame:
        """For batches: every entity with its first related ids as an array."""
        b = self.catalog.bridges[name]
        mine, theirs = (b.left_key, b.right_key) if b.left == kind else (b.right_key, b.left_key)
        edges = self.read(b.table)
        edges = edges.where(b.where) if b.where else edges
        per = edges.groupBy(mine, theirs).agg(*[F.min(s.column).alias(f"_s{i}") for i, s in enumerate(b.sort)] or [F.lit(0).alias("_s0")])
        order = F.struct(*[f"_s{i}" for i in range(max(1, len(b.sort)))], F.col(theirs).alias("id"))
        return per.groupBy(F.col(mine).alias(self.catalog.entities[kind].id)).agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, most), lambda s: s["id"]).alias("ids"))


def localize(df: DataFrame, id_col: str, texts: DataFrame, lang: str, columns: list[str]) -> DataFrame:
    """Columns replaced by the language's row where that isn't blank; no row is lost."""
    t = texts.where(F.col("LANG") == lang).select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = df.join(t, df[id_col] == F.col("_id"), "left")
    pick = lambda c: F.coalesce(F.when(F.trim(F.col(f"_{c}")) != "", F.col(f"_{c}")), F.col(c))
    return j.select(*[pick(c).alias(c) if c in columns else df[c] for c in df.columns])


def main_image(images: DataFrame, id_col: str, lang: str) -> DataFrame:
    """(id, IMAGE_PATH): the first non-blank image of the language by display order."""
    ok = images.where((F.col("LANG") == lang) & (F.trim(F.col("IMAGE_PATH")) != ""))
    return first_by(ok.select(id_col, "IMAGE_PATH", "DISPLAY_ORDER"), [id_col], [F.col("DISPLAY_ORDER"), F.col("IMAGE_PATH")]).select(id_col, "IMAGE_PATH")


def with_main_image(df: DataFrame, id_col: str, path: str, images: DataFrame, lang: str) -> DataFrame:
    """``path`` becomes the language's main image where there is one."""
    best = main_image(images, id_col, lang).select(F.col(id_col).alias("_id"), "IMAGE_PATH")
    j = df.join(best, F.col(id_col) == F.col("_id"), "left")
    return j.select(*[F.coalesce("IMAGE_PATH", F.col(path)).alias(path) if c == path else c for c in df.columns])


def localize_results(df: DataFrame, id_col: str, title: str, lang: str, base: DataFrame, texts: DataFrame, images: DataFrame, french_title: str, path: str = "POSTER_PATH") -> DataFrame:
    """Search rows in another language, by id: title, tagline and poster where the language has a non-blank one; the columns stay the same."""
    if lang == "en":
        return df
    names = base.select(F.col(id_col).alias("_id"), F.lit(lang).alias("LANG"), F.col(french_title).alias(title))
    out = localize(df, id_col, names.withColumnRenamed("_id", id_col), lang, [title])
    if "TAGLINE" in df.columns:
        out = localize(out, id_col, texts, lang, ["TAGLINE"])
    return with_main_image(out, id_col, path, images, lang) if path in df.columns else out


def nested_images(df: DataFrame, kinds: dict[str, tuple[str, DataFrame]], lang: str, kind: str = "CONTENT_TYPE", id_col: str = "ID_CONTENT", path: str = "POSTER_PATH") -> DataFrame:
    """Rows of several kinds with their main image: one batched lookup for each kind, over (kind, id)."""
    all_ = None
    for name, (key, images) in kinds.items():
        x = main_image(images, key, lang).select(F.lit(name).alias("_kind"), F.col(key).alias("_id"), "IMAGE_PATH")
        all_ = x if all_ is None else all_.unionByName(x)
    j = df.join(all_, (F.col(kind) == F.col("_kind")) & (F.col(id_col) == F.col("_id")), "left")
    return j.select(*[F.coalesce("IMAGE_PATH", F.col(path)).alias(path) if c == path else c for c in df.columns])


def language_fallback(pages: DataFrame, key: str, lang: str, sections: str = "n_sections", tie: str = "LANG") -> DataFrame:
    """One page for each key: the language asked for if it has sections, else English, else any."""
    rank = F.when((F.col("LANG") == lang) & (F.col(sections) > 0), 0).when((F.col("LANG") == "en") & (F.col(sections) > 0), 1).when(F.col(sections) > 0, 2).otherwise(3)
    return first_by(pages, [key], [rank, F.col("LANG"), F.col(tie)])


def numbered_neighbours(df: DataFrame, parent: str, number: str, id_col: str, special: Column | None = None) -> DataFrame:
    """(parent, id, previous_id, next_id) by number within the parent; special rows stand outside the chain and have no neighbours."""
    rows = df.select(parent, id_col, number, (F.lit(False) if special is None else F.coalesce(special, F.lit(False))).alias("_special"))
    chain = neighbours(rows.where(~F.col("_special")), [F.col(number), F.col(id_col)], id_col, [parent])
    none = F.lit(None).cast(df.schema[id_col].dataType)
    outside = rows.where("_special").withColumn("previous_id", none).withColumn("next_id", none)
    return chain.unionByName(outside).select(parent, id_col, "previous_id", "next_id")


def collection_contexts(members: DataFrame, collection: str, id_col: str, date: str) -> DataFrame:
    """(id, collection, n_members, previous_id, next_id, position): every collection of every member, the most specific first.

    Members stand in order of date, undated last. Fewest members go first, then
    the soonest next date (none last), then the collection's id.
    """
    n = members.groupBy(collection).agg(F.count("*").alias("n_members"))
    w = Window.partitionBy(collection).orderBy(F.col(date).asc_nulls_last(), F.col(id_col))
    x = members.withColumn("previous_id", F.lag(id_col).over(w)).withColumn("next_id", F.lead(id_col).over(w)).withColumn("_next", F.lead(date).over(w))
    x = x.join(n, collection)
    order = Window.partitionBy(id_col).orderBy("n_members", F.col("_next").asc_nulls_last(), collection)
    return x.withColumn("position", F.row_number().over(order)).select(id_col, collection, "n_members", "previous_id", "next_id", "position")


VIDEO_COLUMNS = ("SOURCE", "VIDEO_KEY", "VIDEO_NAME", "VIDEO_SITE", "VIDEO_TYPE", "OFFICIAL", "DURATION_SECONDS", "WATCH_URL", "EMBED_URL", "FILE_URL", "THUMBNAIL_URL")


def unified_videos(id_col: str, uploaded: DataFrame, resources: DataFrame, urls: DataFrame) -> DataFrame:
    """Videos of two sources in one schema, with their place in the entity's list.

    Uploaded ones come first, official before others, then by display order;
    resources after them, preferred before others, by priority (none last). The
    addresses of uploads are built from site and key, those of resources are
    pivoted by type.
    """
    watch, embed, thumb = video_urls("VIDEO_SITE", "VIDEO_KEY")
    text = F.lit(None).cast("string")
    a = uploaded.where("coalesce(DELETED, 0) = 0").select(
        id_col, F.lit("tmdb").alias("SOURCE"), "VIDEO_KEY", "VIDEO_NAME", "VIDEO_SITE", "VIDEO_TYPE", "OFFICIAL", F.lit(None).cast("int").alias("DURATION_SECONDS"), watch.alias("WATCH_URL"), embed.alias("EMBED_URL"), text.alias("FILE_URL"), thumb.alias("THUMBNAIL_URL"),
        F.struct(F.when(F.col("OFFICIAL") == 1, 0).otherwise(1).alias("a"), F.coalesce(F.col("DISPLAY_ORDER"), F.lit(-(2**31))).cast("long").alias("b"), F.col("ID_ROW").cast("long").alias("c")).alias("_o"),
    )
    kinds = {"watch": "_watch", "embed": "_embed", "file": "_file", "thumbnail": "_thumb", "page": "_page"}
    per = pivot_max(urls.where("IS_ACTIVE = 1"), ["ID_MEDIA_RESOURCE"], "URL_TYPE", "URL", kinds)
    either = lambda x, y: F.coalesce(F.when(F.col(x) != "", F.col(x)), F.col(y))
    r = resources.where("RESOURCE_KIND = 'video' AND DELETED = 0 AND IS_ACTIVE = 1").join(per, "ID_MEDIA_RESOURCE", "left")
    b = r.select(
        id_col, F.lit("wikidata").alias("SOURCE"), F.col("SOURCE_IDENTIFIER").alias("VIDEO_KEY"), F.col("RESOURCE_TITLE").alias("VIDEO_NAME"), F.col("SOURCE_PLATFORM").alias("VIDEO_SITE"), F.col("CONTENT_ROLE").alias("VIDEO_TYPE"), F.lit(None).cast("int").alias("OFFICIAL"), F.col("DURATION_SECONDS").cast("int").alias("DURATION_SECONDS"),
        either("_watch", "_page").alias("WATCH_URL"), F.col("_embed").alias("EMBED_URL"), F.col("_file").alias("FILE_URL"), either("_thumb", "THUMBNAIL_URL_PRIMARY").alias("THUMBNAIL_URL"),
        F.struct((-F.coalesce(F.col("IS_PREFERRED_RESOURCE"), F.lit(-1))).cast("int").alias("a"), F.coalesce(F.col("SOURCE_PRIORITY").cast("long"), F.lit(2**62)).alias("b"), F.col("ID_MEDIA_RESOURCE").cast("long").alias("c")).alias("_o"),
    )
    w = Window.partitionBy(id_col).orderBy("SOURCE_RANK", "_o")
    return concatenated(a, b).withColumn("POSITION", F.row_number().over(w)).select(id_col, *VIDEO_COLUMNS, "POSITION")


def data_freshness(df: DataFrame, source: str, wiki: DataFrame, key: str = "ID_WIKIDATA") -> DataFrame:
    """How old each row is: its own update, under the source's name, and that of the wiki page served with it."""
    w = wiki.select(F.col(key).alias("_k"), F.col("UPDATED_AT").alias("wikipedia_updated_at"), F.col("CRAWLED_AT").alias("wikipedia_crawled_at"), F.col("LANG").alias("wikipedia_lang"))
    when = F.col("TIM_UPDATED")
    j = df.join(w, F.col(key) == F.col("_k"), "left").drop("_k")
    done = F.col("TIM_WIKIDATA_COMPLETED") if "TIM_WIKIDATA_COMPLETED" in df.columns else F.lit(None).cast("timestamp")
    return j.withColumn("record_source", F.lit(source)).withColumn("record_updated_at", when).withColumn("tmdb_updated_at", F.when(F.lit(source == "tmdb"), when)).withColumn("wikidata_updated_at", done)


def in_order(asked: DataFrame, rows: DataFrame, key: str, ids: str = "ids", most: int = 12, images: DataFrame | None = None, per_row: int = 6, path: str = "IMAGE_PATH") -> DataFrame:
    """Rows of listed ids in the list's order: (asked columns, position, row columns).

    The first ``most`` ids of each list; ids without a row are skipped. With
    ``images`` a row comes once for each of its first ``per_row`` images, or
    once with its own path if it has none.
    """
    other = [c for c in asked.columns if c != ids]
    x = asked.select(*other, F.posexplode(F.slice(ids, 1, most)).alias("_p", key)).join(rows, key)
    if images is not None:
        few = top_n(images.select(F.col(key).alias("_k"), F.col("IMAGE_PATH").alias("_path"), "DISPLAY_ORDER"), ["_k"], [F.col("DISPLAY_ORDER"), F.col("_path")], per_row, "_rn").drop("DISPLAY_ORDER")
        x = x.join(few, F.col(key) == F.col("_k"), "left").withColumn(path, F.coalesce("_path", F.col(path))).drop("_k", "_path")
    order = [F.col("_p"), *([F.col("_rn")] if images is not None else [])]
    w = Window.partitionBy(*other).orderBy(*order)
    return x.withColumn("position", F.row_number().over(w) - 1).drop("_p", "_rn")


def _without_votes(kind: T.DataType, value: Column) -> Column | None:
    """The value without vote fields in structs at any depth, None if it holds none."""
    if isinstance(kind, T.ArrayType):
        probe = _without_votes(kind.elementType, F.lit(None))
        return None if probe is None else F.transform(value, lambda x: _without_votes(kind.elementType, x))
    if not isinstance(kind, T.StructType):
        return None
    image = {"TYPE_IMAGE", "IMAGE_PATH"} & set(kind.names)
    fields, changed = [], False
    for f in kind.fields:
        if f.name in ("VOTE_AVERAGE", "VOTE_COUNT") and not image:
            changed = True
            continue
        inner = _without_votes(f.dataType, value[f.name])
        changed = changed or inner is not None
        fields.append((value[f.name] if inner is None else inner).alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields)) if changed else None


def strip_votes(df: DataFrame) -> DataFrame:
    """Vote columns are dropped, in nested rows as well, unless the rows that hold them are images."""
    image = {"TYPE_IMAGE", "IMAGE_PATH"} & set(df.columns)
    out = []
    for f in df.schema.fields:
        if f.name in ("VOTE_AVERAGE", "VOTE_COUNT") and not image:
            continue
        inner = _without_votes(f.dataType, F.col(f.name))
        out.append((F.col(f.name) if inner is None else inner).alias(f.name))
    return df.select(*out)


def collapse_french(df: DataFrame, lang: str) -> DataFrame:
    """``X`` takes a non-blank ``X_FR`` in French; ``X_FR`` goes."""
    pairs = {c[:-3]: c for c in df.columns if c.endswith("_FR") and c[:-3] in df.columns}
    pick = lambda c: F.coalesce(F.when(F.trim(F.col(pairs[c])) != "", F.col(pairs[c])), F.col(c)) if lang == "fr" else F.col(c)
    return df.select(*[pick(c).alias(c) if c in pairs else c for c in df.columns if c not in pairs.values()])

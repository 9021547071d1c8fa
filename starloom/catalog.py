"""A catalogue says what entities, bridges and default sorts a schema has; operators are driven by it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sort:
    """A sort key: column, direction, and where nulls go (None: first ascending, last descending)."""

    column: str
    descending: bool = False
    nulls_last: bool | None = None

    def expr(self) -> Column:
        c = F.col(self.column)
        last = self.descending if self.nulls_last is None else self.nulls_last
        if self.descending:
            return c.desc_nulls_last() if last else c.desc_nulls_first()
        return c.asc_nulls_last() if last else c.asc_nulls_first()


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    id: str
    display: str
    columns: tuple[str, ...]
    sort: tuple[Sort, ...] = ()
    french: tuple[tuple[str, str], ...] = ()

    def order(self) -> list[Column]:
        """The default sort, made stable by the id."""
        return [*(s.expr() for s in self.sort), F.col(self.id).asc()]


@dataclass(frozen=True)
class Bridge:
    """A junction table between two entities; ``where`` is a fixed condition on the edge, such as a credit type."""

    name: str
    table: str
    left: str
    left_key: str
    right: str
    right_key: str
    where: str | None = None
    sort: tuple[Sort, ...] = ()


@dataclass(frozen=True)
class Neighbours:
    """Ranked edges between rows of one entity, such as recommendations."""

    name: str
    table: str
    entity: str
    key: str
    other_key: str
    sort: tuple[Sort, ...] = ()


@dataclass(frozen=True)
class Siblings:
    """Other rows of one entity with the same value in a column."""

    name: str
    entity: str
    by: str


@dataclass(frozen=True)
class Children:
    """Rows of another entity that hold this entity's id; ``rated`` counts a grandchild table's rows with a value."""

    name: str
    entity: str
    other: str
    other_key: str
    sort: tuple[Sort, ...] = ()
    rated: tuple[str, str, str, str] | None = None  # grandchild table, its key to the child, value column, name of the count


@dataclass(frozen=True)
class Properties:
    """Rows of an entity linked to an item over a triple table (key, property, item), on a text key, by some properties."""

    name: str
    entity: str
    table: str
    key: str
    property: str
    item: str
    properties: tuple[str, ...]
    other: str
    other_key: str


Link = Bridge | Neighbours | Siblings | Children | Properties


@dataclass
class Catalog:
    entities: dict[str, Entity] = field(default_factory=dict)
    bridges: dict[str, Bridge] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)

    def add(self, *items: Entity | Link) -> Catalog:
        for x in items:
            if isinstance(x, Entity):
                self.entities[x.name] = x
            else:
                self.links[x.name] = x
                if isinstance(x, Bridge):
                    self.bridges[x.name] = x
        return self

    def between(self, left: str, right: str) -> list[Bridge]:
        return [b for b in self.bridges.values() if {b.left, b.right} == {left, right}]

    def check(self, frames: dict[str, DataFrame]) -> list[str]:
        """Columns that the catalogue names and the tables lack."""
        out = []
        for e in self.entities.values():
            have = set(frames[e.table].columns) if e.table in frames else set()
            out += [f"{e.table}.{c}" for c in (e.id, e.display, *e.columns) if c not in have]
        for b in self.bridges.values():
            have = set(frames[b.table].columns) if b.table in frames else set()
            out += [f"{b.table}.{c}" for c in (b.left_key, b.right_key) if c not in have]
        return sorted(set(out))


def contract_columns(markdown: str, section: str = "Result Columns") -> dict[str, list[str]]:
    """Entity and its result columns from a contract's text: headings below the section's, each with names in backticks."""
    out: dict[str, list[str]] = {}
    inside, depth, entity = False, 0, None
    for line in markdown.splitlines():
        if m := re.match(r"(#+)\s+(.*?)\s*$", line):
            level = len(m[1])
            if not inside and section.lower() in m[2].lower():
                inside, depth = True, level
            elif inside and level <= depth:
                break
            elif inside:
                entity = m[2].strip("`").lower()
        elif inside and entity:
            found = re.findall(r"`([A-Za-z_][A-Za-z0-9_]*)`", line)
            if found:
                out.setdefault(entity, []).extend(found)
    return out


def cinema_catalog() -> Catalog:
    """Entities, result columns and default sorts of the film catalogue."""
    rated = (Sort("IMDB_RATING_WEIGHTED", True),)
    popular = (Sort("POPULARITY", True),)
    title = ("ID_IMDB", "IMDB_RATING", "IMDB_RATING_WEIGHTED", "IMDB_VOTES", "POSTER_PATH")
    c = Catalog().add(
        Entity("movie", "T_WC_T2S_MOVIE", "ID_MOVIE", "MOVIE_TITLE", ("ID_MOVIE", "MOVIE_TITLE", "DAT_RELEASE", *title, "RUNTIME", "TAGLINE"), rated, (("MOVIE_TITLE", "MOVIE_TITLE_FR"),)),
        Entity("serie", "T_WC_T2S_SERIE", "ID_SERIE", "SERIE_TITLE", ("ID_SERIE", "SERIE_TITLE", "DAT_FIRST_AIR", "DAT_LAST_AIR", *title, "NUMBER_OF_SEASONS", "NUMBER_OF_EPISODES", "TAGLINE"), rated, (("SERIE_TITLE", "SERIE_TITLE_FR"),)),
        Entity("person", "T_WC_T2S_PERSON", "ID_PERSON", "PERSON_NAME", ("ID_PERSON", "PERSON_NAME", "POPULARITY", "KNOWN_FOR_DEPARTMENT", "BIRTH_YEAR", "DEATH_YEAR", "PROFILE_PATH"), popular),
        Entity("company", "T_WC_T2S_COMPANY", "ID_COMPANY", "COMPANY_NAME", ("ID_COMPANY", "COMPANY_NAME", "LOGO_PATH", "DESCRIPTION", "ORIGIN_COUNTRY", "HEADQUARTERS"), (Sort("ID_COMPANY"),)),
        Entity("network", "T_WC_T2S_NETWORK", "ID_NETWORK", "NETWORK_NAME", ("ID_NETWORK", "NETWORK_NAME", "LOGO_PATH", "ORIGIN_COUNTRY"), (Sort("ID_NETWORK"),)),
        Entity("genre", "T_WC_TMDB_GENRE", "id", "name", ("id", "name", "APPLIES_TO_MOVIE", "APPLIES_TO_SERIE"), (Sort("name"),)),
        Entity("technical", "T_WC_T2S_TECHNICAL", "ID_TECHNICAL", "DESCRIPTION", ("ID_TECHNICAL", "DESCRIPTION", "DESCRIPTION_FR", "TECHNICAL_TYPE", "OVERVIEW", "WIKIPEDIA_IMAGE_PATH", "MOVIE_COUNT", "IMDB_RATING_WEIGHTED", "POPULARITY"), (Sort("MOVIE_COUNT", True),)),
        Entity("topic", "T_WC_T2S_TOPIC", "ID_TOPIC", "TOPIC_NAME", ("ID_TOPIC", "TOPIC_NAME", "TOPIC_TYPE", "TOPIC_SOURCE", "LANG", "ID_RECORD", "POSTER_PATH", "WIKIPEDIA_IMAGE_PATH", "IMDB_RATING"), rated),
    )
    for n, key, counts, image, sort in (
        ("collection", "ID_T2S_COLLECTION", ("MOVIE_COUNT", "SERIE_COUNT"), "POSTER_PATH", rated),
        ("list", "ID_T2S_LIST", ("MOVIE_COUNT", "SERIE_COUNT"), "POSTER_PATH", rated),
        ("movement", "ID_MOVEMENT", ("MOVIE_COUNT", "SERIE_COUNT"), "POSTER_PATH", rated),
        ("group", "ID_GROUP", ("PERSON_COUNT",), "PROFILE_PATH", popular),
        ("death", "ID_DEATH", ("PERSON_COUNT",), "PROFILE_PATH", popular),
        ("award", "ID_AWARD", ("MOVIE_COUNT", "SERIE_COUNT", "PERSON_COUNT"), "POSTER_PATH", rated),
        ("nomination", "ID_NOMINATION", ("MOVIE_COUNT", "SERIE_COUNT", "PERSON_COUNT"), "POSTER_PATH", rated),
    ):
        u = n.upper()
        tail = ("POPULARITY",) if sort is popular else ("IMDB_RATING",)
        c.add(Entity(n, f"T_WC_T2S_{u}", key, f"{u}_NAME", (key, f"{u}_NAME", f"{u}_SOURCE", f"{u}_TYPE", image, "WIKIPEDIA_IMAGE_PATH", "OVERVIEW", *counts, *tail), sort, ((f"{u}_NAME", f"{u}_NAME_FR"),)))
    ordered = (Sort("DISPLAY_ORDER"),)
    c.add(
        Entity("season", "T_WC_TMDB_SEASON", "ID_SEASON", "TITLE", ("ID_SEASON", "ID_SERIE", "SEASON_NUMBER", "TITLE", "OVERVIEW", "DAT_AIR", "POSTER_PATH", "EPISODE_COUNT", "VOTE_AVERAGE"), (Sort("SEASON_NUMBER"),)),
        Entity("episode", "T_WC_TMDB_EPISODE", "ID_EPISODE", "TITLE", ("ID_EPISODE", "ID_SEASON", "ID_SERIE", "SEASON_NUMBER", "EPISODE_NUMBER", "TITLE", "STILL_PATH"), (Sort("EPISODE_NUMBER"),)),
        Entity("location", "T_WC_T2S_ITEM", "ID_WIKIDATA", "LABEL", ("ID_WIKIDATA", "LABEL", "DESCRIPTION"), (Sort("ID_WIKIDATA"),)),
        Children("serie_seasons", "serie", "season", "ID_SERIE", (Sort("SEASON_NUMBER"),), ("T_WC_T2S_EPISODE", "ID_SEASON", "IMDB_RATING", "IMDB_RATED_EPISODES")),
        Children("season_episodes", "season", "episode", "ID_SEASON", (Sort("EPISODE_NUMBER"),)),
        Siblings("technical_siblings", "technical", "TECHNICAL_TYPE"),
    )
    for kind in ("movie", "serie"):
        u = kind.upper()
        c.add(Neighbours(f"{kind}_similar", f"T_WC_T2S_{u}_SIMILAR", kind, f"ID_{u}", f"ID_{u}_SIMILAR", ordered), Neighbours(f"{kind}_recommendations", f"T_WC_T2S_{u}_RECOMMENDATION", kind, f"ID_{u}", f"ID_{u}_RECOMMENDED", ordered))
        c.add(Properties(f"location_{kind}", "location", "T_WC_WIKIDATA_ITEM_PROPERTY", "ID_WIKIDATA", "ID_PROPERTY", "ID_ITEM", ("P840", "P915"), kind, "ID_WIKIDATA"))
    for left in ("movie", "serie"):
        for right in ("award", "collection", "company", "list", "movement", "nomination", "technical", "topic", "network", "genre"):
            if (left, right) in (("serie", "technical"), ("movie", "network")):
                continue
            key = "ID_GENRE" if right == "genre" else c.entities[right].id
            c.add(Bridge(f"{left}_{right}", f"T_WC_T2S_{left.upper()}_{right.upper()}", left, c.entities[left].id, right, key, sort=ordered))
        for credit in ("cast", "crew"):
            c.add(Bridge(f"person_{left}_{credit}", f"T_WC_T2S_PERSON_{left.upper()}", "person", "ID_PERSON", left, c.entities[left].id, f"CREDIT_TYPE = '{credit}'", ordered))
    for right in ("award", "death", "group", "nomination"):
        c.add(Bridge(f"person_{right}", f"T_WC_T2S_PERSON_{right.upper()}", "person", "ID_PERSON", right, c.entities[right].id, sort=ordered))
    return c


def orders_catalog() -> Catalog:
    """The same concepts on the order tables: orders are titles, suppliers people, lines their credits, parts companies."""
    return Catalog().add(
        Entity("order", "orders", "o_orderkey", "o_orderkey", ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), (Sort("o_totalprice", True),)),
        Entity("supplier", "supplier", "s_suppkey", "s_name", ("s_suppkey", "s_name", "s_acctbal"), (Sort("s_acctbal", True),)),
        Entity("part", "part", "p_partkey", "p_name", ("p_partkey", "p_name", "p_brand", "p_retailprice"), (Sort("p_retailprice", True),)),
        Entity("customer", "customer", "c_custkey", "c_name", ("c_custkey", "c_name", "c_acctbal"), (Sort("c_acctbal", True),)),
        Bridge("order_supplier", "lineitem", "order", "l_orderkey", "supplier", "l_suppkey", sort=(Sort("l_linenumber"),)),
        Bridge("order_supplier_returned", "lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "l_returnflag = 'R'", (Sort("l_linenumber"),)),
        Bridge("order_part", "lineitem", "order", "l_orderkey", "part", "l_partkey", sort=(Sort("l_linenumber"),)),
        Neighbours("part_similar", "part_edges", "part", "part_a", "part_b", (Sort("rank"),)),
        Siblings("part_siblings", "part", "p_type"),
        Children("customer_orders", "customer", "order", "o_custkey", (Sort("o_orderdate"),), ("rated_lines", "l_orderkey", "rating", "rated")),
        Properties("supplier_parts", "supplier", "part_properties", "part_key", "property", "item", ("P840", "P915"), "part", "p_partkey"),
    )

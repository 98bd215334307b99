"""The code property graph as node and edge tables.

Nodes: (snapshot_id, label, id, props map<string,string>).
Edges: (snapshot_id, src_label, src_id, rel, dst_label, dst_id, props).
Name resolution is an equi join against the symbol table; an edge is kept
only if both ends exist as nodes of the right label (C20).  By default the
graph is order-free; ``as_coded=True`` keeps only edges the reference's
file-by-file writer could create (an end must be written no later than the
edge: same or earlier file, and for INHERITS within a file an earlier class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import exchanged
from . import symbols as X
from .snippets import singleton_classes
from .upsert import NODE_KEY

SNAP = "snapshot_id"
PATTERN_ROLE_DEFAULT = "Participant"


def _s(c):
    return F.col(c).cast("string")


def _props(*pairs) -> F.Column:
    args = []
    for k, v in pairs:
        args += [F.lit(k), v]
    return F.create_map(*args)


def _latest(df: DataFrame, key: list[str], ord_col: str) -> DataFrame:
    """Last definition wins per key (C1 with full property sets: one max_by, no explode)."""
    cols = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*cols), ord_col).alias("w"))
            .select(*key, *[F.col("w." + c).alias(c) for c in cols if c != ord_col]))


def file_nodes(parsed: DataFrame) -> DataFrame:
    """One File node per parsed file."""
    return X.ok(parsed).select(SNAP, F.lit("File").alias("label"), F.col("path").alias("id"),
                               _props(("path", F.col("path")),
                                      ("name", F.element_at(F.split("path", "/"), -1))).alias("props"))


def function_nodes(parsed: DataFrame) -> DataFrame:
    """C4: Function nodes; a repeated id within a file keeps the last definition."""
    f = X.functions(parsed).select(SNAP, F.concat("path", F.lit("::"), "name").alias("id"), "path", "name",
                                   "lineno", "end_lineno", "code_snippet", "is_static", "def_ord")
    f = _latest(f, [SNAP, "id"], "def_ord")
    return f.select(SNAP, F.lit("Function").alias("label"), "id",
                    _props(("id", F.col("id")), ("name", F.col("name")), ("lineno", _s("lineno")),
                           ("end_lineno", _s("end_lineno")), ("file_path", F.col("path")),
                           ("code_snippet", F.col("code_snippet")), ("is_static", _s("is_static"))).alias("props"))


def class_nodes(parsed: DataFrame) -> DataFrame:
    """Class nodes; last definition wins per id."""
    c = X.classes(parsed).select(SNAP, F.concat("path", F.lit("::"), "name").alias("id"), "path", "name",
                                 "lineno", "end_lineno", "code_snippet", "def_ord")
    c = _latest(c, [SNAP, "id"], "def_ord")
    return c.select(SNAP, F.lit("Class").alias("label"), "id",
                    _props(("id", F.col("id")), ("name", F.col("name")), ("lineno", _s("lineno")),
                           ("end_lineno", _s("end_lineno")), ("file_path", F.col("path")),
                           ("code_snippet", F.col("code_snippet"))).alias("props"))


def _attributes(parsed: DataFrame) -> DataFrame:
    c = X.classes(parsed)
    return c.select(SNAP, "path", F.concat("path", F.lit("::"), "name").alias("class_id"),
                    F.explode("attributes").alias("attr")).distinct()


def attribute_nodes(parsed: DataFrame) -> DataFrame:
    """Attribute nodes, id path::Class::attr."""
    a = _attributes(parsed)
    return a.select(SNAP, F.lit("Attribute").alias("label"),
                    F.concat("class_id", F.lit("::"), "attr").alias("id"),
                    _props(("id", F.concat("class_id", F.lit("::"), "attr")), ("name", F.col("attr")),
                           ("class_id", F.col("class_id")), ("file_path", F.col("path"))).alias("props"))


def package_nodes(parsed: DataFrame) -> DataFrame:
    """One Package node per distinct module name in the snapshot."""
    return (X.imports(parsed).select(SNAP, F.col("module").alias("id")).distinct()
            .select(SNAP, F.lit("Package").alias("label"), "id", _props(("name", F.col("id"))).alias("props")))


def pattern_nodes(parsed: DataFrame) -> DataFrame:
    """C15 nodes: one DesignPattern node per detected pattern name."""
    return (singleton_classes(X.classes(parsed)).select(SNAP).distinct()
            .select(SNAP, F.lit("DesignPattern").alias("label"), F.lit("Singleton").alias("id"),
                    _props(("name", F.lit("Singleton"))).alias("props")))


def nodes(parsed: DataFrame) -> DataFrame:
    parts = [file_nodes(parsed), function_nodes(parsed), class_nodes(parsed), attribute_nodes(parsed),
             package_nodes(parsed), pattern_nodes(parsed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# What makes an edge: it exists once per snapshot, source, relation and target.
EDGE = [SNAP, "src_label", "src_id", "rel", "dst_label", "dst_id"]


def _edge(df: DataFrame, src_label: str, src: str, rel: str, dst_label: str, dst: str, props=None) -> DataFrame:
    p = props if props is not None else F.create_map().cast("map<string,string>")
    return df.select(SNAP, F.lit(src_label).alias("src_label"), F.col(src).alias("src_id"), F.lit(rel).alias("rel"),
                     F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst_id"), p.alias("props"))


def contains_edges(parsed: DataFrame) -> DataFrame:
    """File->Function, File->Class, Class->Attribute."""
    f = X.functions(parsed).select(SNAP, "path", F.concat("path", F.lit("::"), "name").alias("fid"))
    c = X.classes(parsed).select(SNAP, "path", F.concat("path", F.lit("::"), "name").alias("cid"))
    a = _attributes(parsed).select(SNAP, "class_id", F.concat("class_id", F.lit("::"), "attr").alias("aid"))
    return (_edge(f, "File", "path", "CONTAINS_FUNCTION", "Function", "fid")
            .unionByName(_edge(c, "File", "path", "CONTAINS_CLASS", "Class", "cid"))
            .unionByName(_edge(a, "Class", "class_id", "HAS_ATTRIBUTE", "Attribute", "aid"))
            .dropDuplicates(EDGE))


def _resolve(df: DataFrame, st: DataFrame, name_col: str, out_col: str) -> DataFrame:
    """Inner equi join to the symbol table on (snapshot, name)."""
    t = st.select(SNAP, F.col("name").alias(name_col), F.col("symbol_id").alias(out_col))
    return df.join(exchanged(t), [SNAP, name_col])


def _class_first_ord(parsed: DataFrame) -> DataFrame:
    return (X.classes(parsed).groupBy(SNAP, F.concat("path", F.lit("::"), "name").alias("cid"))
            .agg(F.min("def_ord").alias("first_ord")))


def inherits_overrides(parsed: DataFrame, st: DataFrame, as_coded: bool = False) -> DataFrame:
    """C11 INHERITS (base by bare name) and C12 OVERRIDES (Class.m -> Base.m), endpoints checked."""
    c = X.classes(parsed).select(SNAP, "path", "name", "def_ord", F.explode("bases").alias("base"))
    cb = _resolve(c, st, "base", "base_id").withColumn("cid", F.concat("path", F.lit("::"), "name"))
    inh = cb
    if as_coded:
        fo = _class_first_ord(parsed).select(SNAP, F.col("cid").alias("base_id"), F.col("first_ord").alias("base_ord"))
        inh = (inh.join(exchanged(fo), [SNAP, "base_id"], "left")
               .filter((F.substring_index("base_id", "::", 1) < F.col("path"))
                       | ((F.substring_index("base_id", "::", 1) == F.col("path"))
                          & (F.col("base_ord") <= F.col("def_ord")))))
    inherits = _edge(inh, "Class", "cid", "INHERITS", "Class", "base_id")

    # Methods of the class in the same file: names 'Class.m'.
    f = X.functions(parsed).select(SNAP, "path", F.col("name").alias("fname"))
    meth = f.filter(F.col("fname").contains(".")).select(
        SNAP, "path", "fname", F.substring_index("fname", ".", 1).alias("name"),
        F.element_at(F.split("fname", "\\."), 2).alias("method"))
    ov = (cb.select(SNAP, "path", "name", "base").distinct()
          .join(exchanged(meth), [SNAP, "path", "name"])
          .withColumn("target", F.concat("base", F.lit("."), "method")))
    ov = _resolve(ov, st, "target", "target_id").withColumn("fid", F.concat("path", F.lit("::"), "fname"))
    if as_coded:
        ov = ov.filter(F.substring_index("target_id", "::", 1) <= F.col("path"))
    overrides = _edge(ov, "Function", "fid", "OVERRIDES", "Function", "target_id")
    # Getter and setter, or a class defined in both branches of an if, name one edge.
    return inherits.unionByName(overrides).dropDuplicates(EDGE)


def calls_edges(parsed: DataFrame, st: DataFrame, as_coded: bool = False) -> DataFrame:
    """Exact symbol lookup, else alias-expanded 'alias.rest' lookup for dotted callees."""
    cl = X.call_lists(parsed).select(SNAP, "path", "caller", F.explode("callees").alias("callee")).distinct()
    al = X.aliases(parsed).select(SNAP, "path", F.col("alias").alias("head"), F.col("module").alias("expanded_head"))
    dotted = F.col("callee").contains(".")
    cand = (cl.withColumn("head", F.when(dotted, F.substring_index("callee", ".", 1)))
            .withColumn("rest", F.when(dotted, F.expr("substr(callee, instr(callee, '.') + 1)")))
            .join(exchanged(al), [SNAP, "path", "head"], "left")
            # A callee without a dot is looked up by its own name again: nulls would be one task's.
            .withColumn("expanded", F.when(dotted, F.concat(F.coalesce("expanded_head", "head"), F.lit("."), "rest"))
                        .otherwise(F.col("callee"))))
    names = st.select(SNAP, "name", "symbol_id")
    direct = names.select(SNAP, F.col("name").alias("callee"), F.col("symbol_id").alias("direct_id"))
    viaalias = names.select(SNAP, F.col("name").alias("expanded"), F.col("symbol_id").alias("alias_id"))
    res = (cand.join(exchanged(direct), [SNAP, "callee"], "left")
           .join(exchanged(viaalias), [SNAP, "expanded"], "left")
           .withColumn("callee_id", F.coalesce("direct_id", "alias_id"))
           .filter(F.col("callee_id").isNotNull())
           .withColumn("caller_id", F.concat("path", F.lit("::"), "caller")))
    if as_coded:
        res = res.filter(F.substring_index("callee_id", "::", 1) <= F.col("path"))
    return _edge(res, "Function", "caller_id", "CALLS", "Function", "callee_id").dropDuplicates(EDGE)


def imports_edges(parsed: DataFrame) -> DataFrame:
    """C14: File -> Package."""
    i = X.imports(parsed).select(SNAP, "path", "module").distinct()
    return _edge(i, "File", "path", "IMPORTS", "Package", "module")


def pattern_edges(parsed: DataFrame) -> DataFrame:
    """Class -PARTICIPATES_IN {role}-> DesignPattern."""
    s = singleton_classes(X.classes(parsed)).select(SNAP, F.concat("path", F.lit("::"), "name").alias("cid"),
                                                    F.lit("Singleton").alias("pattern"),
                                                    F.lit("Singleton").alias("role"))
    return _edge(s, "Class", "cid", "PARTICIPATES_IN", "DesignPattern", "pattern",
                 _props(("role", F.coalesce(F.col("role"), F.lit(PATTERN_ROLE_DEFAULT))))).dropDuplicates(EDGE)


def participant_edges(findings: DataFrame, node_table: DataFrame) -> DataFrame:
    """C15 for findings of any detector: (snapshot_id, pattern, participant, role null) -> PARTICIPATES_IN edges.

    A participant is the id of a Class, else of a Function (a file may hold both under one id); findings of
    neither are left out.  A missing role becomes the default; of several findings of one participant and
    pattern the last role by name stays.  One join: the label is the first in rank among the ids' nodes.
    """
    n = (node_table.where(F.col("label").isin("Class", "Function")).groupBy(SNAP, F.col("id").alias("participant"))
         .agg(F.min("label").alias("src_label")))           # Class sorts before Function
    found = findings.select(SNAP, "pattern", "participant", F.coalesce("role", F.lit(PATTERN_ROLE_DEFAULT)).alias("role"))
    once = found.groupBy(SNAP, "pattern", "participant").agg(F.max("role").alias("role")).join(exchanged(n), [SNAP, "participant"])
    return once.select(SNAP, "src_label", F.col("participant").alias("src_id"), F.lit("PARTICIPATES_IN").alias("rel"),
                       F.lit("DesignPattern").alias("dst_label"), F.col("pattern").alias("dst_id"), _props(("role", F.col("role"))).alias("props"))


def check_endpoints(edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """C20 per snapshot: both (label, id) ends must exist."""
    n = node_table.select(SNAP, *NODE_KEY)
    src = n.select(SNAP, F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    dst = n.select(SNAP, F.col("label").alias("dst_label"), F.col("id").alias("dst_id"))
    return (edges.join(exchanged(src), [SNAP, "src_label", "src_id"], "left_semi")
            .join(exchanged(dst), [SNAP, "dst_label", "dst_id"], "left_semi"))

"""Code intelligence over files that are derived from ``part``: one small module each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.operators import code, code_index, scopes
from lodestone.operators.graph import shared_folder
from lodestone.plans.registry import query
from lodestone.sources import files as files_of
from lodestone.sources import ignore, table

_TEXT = """'import os' || chr(10) || 'from m' || p_size || '.util import helper' || chr(10) || chr(10) || 'class Thing' || p_partkey || ':' || chr(10) || '    def run(self):' || chr(10)
  || '        return helper(self, build_' || (p_partkey + 1) || '())' || chr(10) || chr(10) || '@router.' || ['get', 'post', 'delete'][CAST(1 + p_partkey % 3 AS INT)] || '("/parts/' || p_size || '/{id}")' || chr(10)
  || 'def build_' || p_partkey || '():' || chr(10) || '    return os.walk(Thing' || p_partkey || '())' || chr(10)"""
_FILES = f"f AS (SELECT 'src/m' || p_size || '/f' || p_partkey || '.py' AS path, {_TEXT} AS text FROM part)"


def files(spark, sf_dir):
    """Rows (path, text)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    method = F.get(F.array(*map(F.lit, ("get", "post", "delete"))), (k % 3).cast("int"))
    lines = [
        "import os", F.concat(F.lit("from m"), size, F.lit(".util import helper")), "", F.concat(F.lit("class Thing"), k, F.lit(":")), "    def run(self):",
        F.concat(F.lit("        return helper(self, build_"), k + 1, F.lit("())")), "", F.concat(F.lit("@router."), method, F.lit('("/parts/'), size, F.lit('/{id}")')),
        F.concat(F.lit("def build_"), k, F.lit("():")), F.concat(F.lit("    return os.walk(Thing"), k, F.lit("())")), "",
    ]
    text = F.array_join(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in lines)), "\n")
    return _parts(spark, sf_dir).select(F.concat(F.lit("src/m"), size, F.lit("/f"), k, F.lit(".py")).alias("path"), text.alias("text"))


def _parts(spark, sf_dir):
    """The parts in tasks of a bounded number: a few bytes of each become a file."""
    return code.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


_LINES = f"{_FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f)"
_SYMBOLS = rf"""{_LINES}, s AS (SELECT path, regexp_extract(code, '^\s*(?:async\s+)?(?:def|class|function)\s+([A-Za-z_]\w*)', 1) AS name,
  CASE WHEN regexp_matches(code, '^\s*class\b') THEN 'class' WHEN regexp_matches(code, '^\s+') THEN 'method' ELSE 'function' END AS kind, CAST(line AS INT) AS line FROM l)"""


@query("code_symbols", f"WITH {_SYMBOLS} SELECT * FROM s WHERE name <> ''")
def code_symbols(spark, sf_dir):
    """Symbols of all files."""
    return code.symbol_lines(files(spark, sf_dir))


@query("code_counts", f"WITH {_SYMBOLS} SELECT kind, count(*) AS symbols, count(DISTINCT path) AS files, count(DISTINCT name) AS names FROM s WHERE name <> '' GROUP BY 1")
def code_counts(spark, sf_dir):
    """Symbols, files and names by kind."""
    return code.symbol_counts(code.symbol_lines(files(spark, sf_dir)), 3 * table(spark, sf_dir, "part").count())  # three symbols a file


@query("code_lookup", f"WITH {_SYMBOLS} SELECT name, path, line FROM s WHERE kind = 'function' AND name IN (SELECT 'build_' || p_partkey FROM part WHERE p_partkey % 20 = 0) AND path NOT IN (SELECT path FROM s WHERE name = 'Thing40')")
def code_lookup(spark, sf_dir):
    """Definitions of some names after one file was taken out."""
    found = code.symbol_lines(files(spark, sf_dir))
    wanted = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("build_"), "p_partkey").alias("name"))
    return found.where("kind = 'function'").join(wanted, "name", "left_semi").join(found.where("name = 'Thing40'").select("path"), "path", "left_anti").select("name", "path", "line")


@query("code_imports", f"WITH {_LINES} SELECT DISTINCT path, regexp_extract(code, '^\\s*(?:import|from)\\s+([A-Za-z_][\\w.]*)', 1) AS module FROM l WHERE regexp_matches(code, '^\\s*(import|from)\\s')")
def code_imports(spark, sf_dir):
    """What every file imports."""
    return code.imports(files(spark, sf_dir))


@query(
    "code_calls",
    f"""
WITH {_SYMBOLS}, d AS (SELECT name, path || ':' || name AS target FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line) AS r FROM s WHERE name <> '') WHERE r = 1),
c AS (SELECT DISTINCT path, unnest(regexp_extract_all(code, '([A-Za-z_]\\w*)\\s*\\(', 1)) AS name FROM l WHERE NOT regexp_matches(code, '^\\s*(def|class|async def|function)\\b'))
SELECT c.path, c.name, target FROM c JOIN d ON d.name = c.name""",
)
def code_calls(spark, sf_dir):
    """Calls of known symbols, with the first place that defines each."""
    found = code.symbol_lines(files(spark, sf_dir))
    return code.calls(files(spark, sf_dir), found.select("name", "path", F.col("line").alias("first_line"), F.col("name").alias("qualified")))


@query("code_routes", f"""WITH {_LINES} SELECT path, upper(regexp_extract(code, '@\\w+\\.(\\w+)\\(', 1)) AS method, regexp_extract(code, '"([^"]+)"', 1) AS template FROM l WHERE starts_with(code, '@router')""")
def code_routes(spark, sf_dir):
    """Routes that decorators declare."""
    return code.routes(files(spark, sf_dir))


_ASKED = "a AS (SELECT DISTINCT ['GET', 'POST', 'PUT'][CAST(1 + s_suppkey % 3 AS INT)] AS method, CASE WHEN s_suppkey % 5 = 0 THEN '/parts/' || (s_suppkey % 50) || '/{id}' WHEN s_suppkey % 5 = 1 THEN '/none/' || s_suppkey ELSE '/parts/' || (s_suppkey % 50) || '/' || s_suppkey END AS path FROM supplier)"


@query(
    "code_endpoints",
    f"""
WITH {_LINES}, r AS (SELECT DISTINCT upper(regexp_extract(code, '@\\w+\\.(\\w+)\\(', 1)) AS method, regexp_extract(code, '"([^"]+)"', 1) AS template FROM l WHERE starts_with(code, '@router')), {_ASKED},
s AS (SELECT a.method, a.path, max(CASE WHEN regexp_full_match(a.path, regexp_replace(r.template, '\\{{[^}}]*\\}}', '[^/]+')) THEN CASE WHEN a.method = r.method AND a.path = r.template THEN 3 WHEN a.method = r.method THEN 2 ELSE 1 END ELSE 0 END) AS s FROM a CROSS JOIN r GROUP BY 1, 2)
SELECT method, path, ['missing', 'wrong_method', 'template', 'exact'][s + 1] AS verdict, CAST([0.8, 0.9, 0.95, 1.0][s + 1] AS DOUBLE) AS confidence FROM s""",
)
def code_endpoints(spark, sf_dir):
    """Whether endpoints that were named exist."""
    k = F.col("s_suppkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/parts/"), k % 50, F.lit("/{id}"))).when(k % 5 == 1, F.concat(F.lit("/none/"), k)).otherwise(F.concat(F.lit("/parts/"), k % 50, F.lit("/"), k))
    asked = table(spark, sf_dir, "supplier").select(F.get(F.array(*map(F.lit, ("GET", "POST", "PUT"))), (k % 3).cast("int")).alias("method"), path.alias("path")).distinct()
    return code.endpoint_checks(asked, code.routes(files(spark, sf_dir)).select("method", "template").distinct())


@query(
    "code_paths",
    f"""
WITH {_FILES}, a AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN './src/m' || (SELECT p_size FROM part WHERE p_partkey = s_suppkey) || '/f' || s_suppkey || '.py' WHEN 1 THEN '/lib/f' || s_suppkey || '.py' WHEN 2 THEN '../x/' || s_suppkey ELSE 'no/g' || s_suppkey || '.py' END AS path, s_suppkey % 4 AS k FROM supplier)
SELECT path, ['known', 'similar', 'outside', 'missing'][CAST(k + 1 AS INT)] AS verdict, CAST([1.0, 0.85, 1.0, 0.8][CAST(k + 1 AS INT)] AS DOUBLE) AS confidence FROM a""",
)
def code_paths(spark, sf_dir):
    """Whether paths that were named exist."""
    k = F.col("s_suppkey")
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_size")
    path = F.when(k % 4 == 0, F.concat(F.lit("./src/m"), "p_size", F.lit("/f"), k, F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("/lib/f"), k, F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit("../x/"), k)).otherwise(F.concat(F.lit("no/g"), k, F.lit(".py")))
    asked = table(spark, sf_dir, "supplier").join(sizes, "s_suppkey", "left").select(path.alias("path"))
    return code.path_checks(asked, files(spark, sf_dir).select("path"))


@query(
    "code_references",
    """
WITH t AS (SELECT p_partkey FROM part)
SELECT p_partkey, unnest(['function_call', 'class_name', 'class_name', 'file_path', 'api_endpoint', 'import', 'qualified_name', 'qualified_name']) AS kind,
  unnest(['build_' || p_partkey, 'Thing' || p_partkey, 'GET', 'src/f' || p_partkey || '.py', '/parts/' || p_partkey, 'os.path', 'f' || p_partkey || '.py', 'os.path']) AS name FROM t""".replace("'class_name', 'class_name'", "'class_name'").replace("'Thing' || p_partkey, 'GET'", "'Thing' || p_partkey"),
)
def code_references(spark, sf_dir):
    """What answers refer to: calls, classes, files, endpoints, imports and qualified names."""
    k = F.col("p_partkey")
    said = F.concat(F.lit("use build_"), k, F.lit("() of Thing"), k, F.lit(" in src/f"), k, F.lit(".py: import os.path, then GET /parts/"), k)
    return code.references(table(spark, sf_dir, "part").select("p_partkey", said.alias("said")), "p_partkey", "said")


@query(
    "code_file_chunks",
    f"""
WITH {_SYMBOLS}, plain AS (SELECT 'README' || r_regionkey || '.md' AS path, 'About ' || r_name AS text FROM region),
n AS (SELECT path, line AS lo, lead(line, 1, 10000) OVER (PARTITION BY path ORDER BY line) - 1 AS hi, name FROM s WHERE name <> '' AND kind <> 'method')
SELECT n.path, name AS qualified, string_agg(code, chr(10) ORDER BY l.line) AS content FROM n JOIN l ON l.path = n.path AND l.line BETWEEN lo AND hi GROUP BY ALL
UNION ALL SELECT path, '', text FROM plain""".replace("GROUP BY ALL", "GROUP BY n.path, name"),
)
def code_file_chunks(spark, sf_dir):
    """Files by symbol; one without symbols is a chunk of its own."""
    from pyspark.sql import Window

    some = files(spark, sf_dir)
    plain = table(spark, sf_dir, "region").select(F.concat(F.lit("README"), "r_regionkey", F.lit(".md")).alias("path"), F.concat(F.lit("About "), "r_name").alias("text"))
    found = code.symbol_lines(some).where("kind <> 'method'")
    upto = F.lead("line", 1, 10_000).over(Window.partitionBy("path").orderBy("line")) - 1
    spans = found.select("path", "name", "line", upto.alias("upto")).join(some, "path")
    text = F.array_join(F.expr("slice(split(text, '\n'), line, upto - line + 1)"), "\n")
    chunks = spans.select("path", F.col("name").alias("qualified"), F.lit(0).alias("part"), text.alias("content"))
    return code.or_whole_files(some.union(plain), chunks).select("path", "qualified", "content")


def edited(spark, sf_dir):
    """The files after a round of work: some are gone, some have moved, some define or call other names."""
    k = F.regexp_extract("path", r"f(\d+)\.py$", 1).cast("long")
    renamed = F.when(k % 7 == 0, F.replace("text", F.lit("def build_"), F.lit("def make_"))).otherwise(F.col("text"))
    called = F.when(k % 5 == 0, F.concat(renamed, F.lit("run()\n"))).otherwise(renamed)
    path = F.when(k % 13 == 0, F.concat(F.lit("lib/f"), k, F.lit(".py"))).otherwise(F.col("path"))
    return files(spark, sf_dir).where(k % 11 != 0).select(path.alias("path"), called.alias("text"))


_EDITED = f"""g AS (SELECT 'src/m' || p_size || '/f' || p_partkey || '.py' AS path, {_TEXT} AS text, p_partkey AS k FROM part),
f AS (SELECT CASE WHEN k % 13 = 0 THEN 'lib/f' || k || '.py' ELSE path END AS path,
  CASE WHEN k % 7 = 0 THEN replace(text, 'def build_', 'def make_') ELSE text END || CASE WHEN k % 5 = 0 THEN 'run()' || chr(10) ELSE '' END AS text FROM g WHERE k % 11 <> 0)"""


@query(
    "code_index_edges",
    f"""
WITH {_SYMBOLS.replace(_FILES, _EDITED)},
d AS (SELECT name, path || ':' || CASE kind WHEN 'method' THEN 'Thing' || regexp_extract(path, 'f(\\d+)\\.py$', 1) || '.' ELSE '' END || name AS target FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line) AS r FROM s WHERE name <> '') WHERE r = 1),
c AS (SELECT DISTINCT path, unnest(regexp_extract_all(code, '([A-Za-z_]\\w*)\\s*\\(', 1)) AS name FROM l WHERE NOT regexp_matches(code, '^\\s*(def|class|async def|function)\\b'))
SELECT c.path, c.name, target FROM c JOIN d ON d.name = c.name""",
)
def code_index_edges(spark, sf_dir):
    """Calls out of an index that was made of the files and then brought to their edited state by what changed."""
    folder = f"{shared_folder(spark)}/code-{uuid.uuid4().hex}"
    code_index.create(spark, folder)
    code_index.update(files(spark, sf_dir), folder)
    code_index.update(edited(spark, sf_dir), folder)
    return code_index.edges(spark, folder)


# The ignore files of five repositories.
_IGNORE = (
    "# all but one folder of that name\nm8/\nm7\n!/src/m7\n",
    "*.py\n!f1*.py\n",
    "/src/m1*/\n!/src/m11/f2*.py\n",
    "src/**/f?0.py\nf[!0-5]*.py\n",
    "**/m2?/**\n\\#none\nm3\\?\n",
)


@query(
    "code_scanned",
    r"""
WITH f AS (SELECT p_partkey % 5 AS repo, p_size AS m, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT repo, 'src/m' || m || '/f' || k || '.py' AS path, 'python' AS language FROM f WHERE CASE repo WHEN 0 THEN m <> 8 WHEN 1 THEN k[1] = '1'
  WHEN 2 THEN CAST(m AS VARCHAR)[1] <> '1' WHEN 3 THEN NOT regexp_full_match(k, '[0-9]0') AND k[1] IN ('0', '1', '2', '3', '4', '5') ELSE m NOT BETWEEN 20 AND 29 END""",
)
def code_scanned(spark, sf_dir):
    """Source files that the ignore file of their repository leaves."""
    repo = F.regexp_extract("path", r"f(\d+)\.py$", 1).cast("long") % 5
    texts = F.get(F.array(*map(F.lit, _IGNORE)), F.col("r_regionkey").cast("int"))
    given = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("repo"), texts.alias("text"))
    found = files_of.scanned(files(spark, sf_dir).select(repo.alias("repo"), "path"), ())
    return ignore.kept(found, given, "repo")


def nested_files(spark, sf_dir):
    """Rows (path, text): for each part a Python or TypeScript file with a class of ``p_size % 4`` methods, the first with a function inside, and a function after it."""
    k, n, py = F.col("p_partkey"), (F.col("p_size") % 4).cast("int"), F.col("p_partkey") % 2 == 0
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    say = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    inner = lambda i, text: F.when(i == 1, F.lit(text)).otherwise(F.lit(""))
    python = F.transform(numbers, lambda i: say("    def m", i, '(self, a="):",\n           b=(1,\n    2)):\n        """Says\nclass No:\n        """\n', inner(i, "        def inner():\n            return a\n"), "        return b\n\n"))
    script = F.transform(numbers, lambda i: say("  async m", i, "(a, { b } = {}) {\n    // class No {\n", inner(i, "    const inner = (x) => {\n      return `}`;\n    };\n"), "    return a;\n  }\n\n"))
    python = say("class Box", k, ':\n    size = "class No:"\n\n', F.array_join(python, ""), "def build", k, "():\n    return Box", k, "()\n")
    script = say("export class Box", k, " {\n  size = 1;\n\n", F.array_join(script, ""), "}\nexport function build", k, "() {\n  return new Box", k, "();\n}\n")
    path = say("src/m", F.col("p_size"), "/f", k, F.when(py, ".py").otherwise(".ts"))
    return _parts(spark, sf_dir).select(path.alias("path"), F.when(py, python).otherwise(script).alias("text"))


# the same symbols counted out: a Python method takes 8 lines and 2 more around a function of its own, a script's 5 and 3
_NESTED = """
t AS (SELECT p_partkey AS k, p_size % 4 AS n, p_partkey % 2 = 0 AS py, 'src/m' || p_size || '/f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path FROM part),
m AS (SELECT *, unnest(range(1, n + 1)) AS i FROM t),
a AS (SELECT *, 4 + (i - 1) * CASE WHEN py THEN 8 ELSE 5 END + CASE WHEN i = 1 THEN 0 WHEN py THEN 2 ELSE 3 END AS lo, CASE WHEN py THEN 7 ELSE 4 END + CASE WHEN i > 1 THEN 0 WHEN py THEN 2 ELSE 3 END AS size FROM m),
e AS (SELECT *, CASE WHEN n = 0 THEN 3 ELSE 3 + n * CASE WHEN py THEN 8 ELSE 5 END + CASE WHEN py THEN 2 ELSE 3 END END AS body FROM t),
s AS (
  SELECT path, 'Box' || k AS name, 'class' AS kind, 'Box' || k AS qualified, 1 AS first_line, CASE WHEN NOT py THEN body + 1 WHEN n = 0 THEN 2 ELSE body - 1 END AS last_line FROM e
  UNION ALL SELECT path, 'm' || i, 'method', 'Box' || k || '.m' || i, lo, lo + size - 1 FROM a
  UNION ALL SELECT path, 'inner', 'function', 'Box' || k || '.m1.inner', CASE WHEN py THEN lo + 6 ELSE lo + 2 END, CASE WHEN py THEN lo + 7 ELSE lo + 4 END FROM a WHERE i = 1
  UNION ALL SELECT path, 'build' || k, 'function', 'build' || k, CASE WHEN py THEN body + 1 ELSE body + 2 END, CASE WHEN py THEN body + 2 ELSE body + 4 END FROM e)"""


@query("code_scopes", f"WITH {_NESTED} SELECT path, name, kind, qualified, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line FROM s")
def code_scopes(spark, sf_dir):
    """Symbols of nested files in two languages, with their scopes and last lines."""
    return scopes.symbols(nested_files(spark, sf_dir))


@query(
    "code_method_chunks",
    f"""
WITH {_NESTED}, o AS (SELECT s.*, t.py, t.k FROM s JOIN t ON t.path = s.path)
SELECT path, qualified, CAST(last_line - first_line + 1 + CASE WHEN kind = 'method' THEN 1 ELSE 0 END AS INT) AS n_lines,
  CASE WHEN kind IN ('method', 'class') THEN CASE WHEN py THEN 'class Box' || k || ':' ELSE 'export class Box' || k || ' {{' END END AS header FROM o""",
)
def code_method_chunks(spark, sf_dir):
    """Chunks of those symbols in whole: methods stand below the first line of their class."""
    some = nested_files(spark, sf_dir)
    chunks = code.code_chunks(some, scopes.symbols(some), 1_000_000, headers=True)
    first = F.substring_index("content", "\n", 1)
    return chunks.select("path", "qualified", F.size(F.split("content", "\n")).alias("n_lines"), F.when(first.rlike("^(export )?class "), first).alias("header"))


@query(
    "code_verdicts",
    f"""
WITH {_NESTED}, r AS (SELECT k, unnest(['Box' || k, 'build' || k, 'build' || k || 'x', 'Qqq' || k]) AS name, unnest(['class', 'class', 'function', NULL]) AS kind, unnest([1.0, 0.9, 0.85, 0.8]) AS confidence FROM t WHERE k % 20 = 0)
SELECT name, kind, confidence = 1.0 AS is_valid, CAST(confidence AS DOUBLE) AS confidence FROM r""",
)
def code_verdicts(spark, sf_dir):
    """Whether names in answers about every twentieth part are symbols of its files: right, of another kind, misspelt, unheard of."""
    k = F.col("p_partkey")
    said = [("Box", "", "class"), ("build", "", "class"), ("build", "x", "function"), ("Qqq", "", None)]
    asked = F.explode(F.array(*(F.struct(F.concat(F.lit(a), k, F.lit(b)).alias("name"), F.lit(kind).cast("string").alias("kind")) for a, b, kind in said)))
    references = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(asked.alias("r")).select("r.name", "r.kind")
    return code.symbol_verdicts(references, scopes.symbols(nested_files(spark, sf_dir))).drop("similar")


_MANIFEST = """
[project]
name = "p"  # not a package
dependencies = ["first{k}[extra]>=1; python_version > '3'", 'second{s}', "third @ https://x.example/{k}"]
[project.optional-dependencies]
dev = ["fourth{s}~=2"]
[tool.poetry.dependencies]
python = "^3"
fifth{k} = "1"
"""
_PACKAGE = '{"name": "p", "dependencies": {"first{k}": "1", "@x/second{s}": "2"}, "devDependencies": {"third": "*"}, "scripts": {"no": "x"}}'


@query(
    "declared_packages",
    """
SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['first' || p_partkey, 'second' || p_size, 'third', 'fourth' || p_size, 'fifth' || p_partkey] ELSE ['first' || p_partkey, '@x/second' || p_size, 'third'] END) AS package FROM part""",
)
def declared_packages(spark, sf_dir):
    """Packages that the manifests of all parts declare, in TOML and in JSON."""
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    names = F.when(F.col("p_partkey") % 2 == 0, markup.toml_packages(filled(_MANIFEST))).otherwise(markup.json_packages(filled(_PACKAGE)))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(names).alias("package"))


@query(
    "imports_checked",
    """
WITH m AS (SELECT p_partkey, unnest(['os', 'm' || p_size || '.util', 'first' || p_partkey, 'second_' || p_size || '.x', 'lost' || p_partkey]) AS module, unnest(['stdlib', 'local', 'declared', 'installed', 'missing']) AS origin FROM part)
SELECT DISTINCT module, origin FROM m""",
)
def imports_checked(spark, sf_dir):
    """Where imported modules come from: the language, what is installed or declared, the tree itself, or nowhere."""
    parts, k, size = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    extra = F.concat(F.lit("import second_"), size, F.lit(".x\nimport first"), k, F.lit("\nfrom lost"), k, F.lit(" import y\n"))
    own = files(spark, sf_dir).unionByName(parts.select(F.concat(F.lit("lib/f"), k).alias("path"), extra.alias("text")))
    wanted = code.imports(own).select("module").distinct()
    installed = parts.select(F.concat(F.lit("Second-"), size).alias("module")).distinct()
    declared = declared_packages(spark, sf_dir).select(F.col("package").alias("module")).distinct()
    local = files(spark, sf_dir).select(F.split("path", "/")[1].alias("module")).distinct()
    return code.import_checks(wanted, spark.createDataFrame([("os",), ("sys",)], "module string"), installed, declared, local)

"""Symbols of nested code, against the grammar and on files of known symbols."""

import ast
import inspect
import json.decoder
import textwrap
import dataclasses

from lodestone.operators import code, scopes

SCHEMA = "path string, text string"


def by_grammar(text):
    out = set()

    def walk(node, prefix, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = prefix + child.name
                out.add((child.name, "class" if is_class else "method" if in_class else "function", name, child.lineno, child.end_lineno))
                walk(child, name + ".", is_class)
            else:
                walk(child, prefix, in_class)

    walk(ast.parse(text), "", False)
    return out


def got(df, path):
    return {tuple(r)[1:] for r in df.collect() if r["path"] == path}


ODD = '''
def one(a={"(": 1},
        b="""
def no():
"""): # def neither(): (
    """Text
class Nor: (
    """
    x = 1 + \\
2
    return [
x,
    ]

class A(object):

    @property
    def p(self): return "#"

    async def q(self):
        if self:
            def inner(): pass
            class B:
                def deep(self):
                    pass

        # the end
        return 'it\\'s', r"\\\\"
    if True:
        def maybe(self):
            return {
            }
x = 1
if x:
    def late():
        pass
'''


def test_indented_equals_the_grammar(spark):
    texts = {"odd.py": ODD, "own.py": inspect.getsource(scopes), "code.py": inspect.getsource(code), "wrap.py": inspect.getsource(textwrap), "data.py": inspect.getsource(dataclasses), "json.py": inspect.getsource(json.decoder), "plain.py": "x = 1\n"}
    rows = scopes.indented(spark.createDataFrame([*texts.items(), ("none.py", None), ("empty.py", "")], SCHEMA))
    found = rows.collect()
    for path, text in texts.items():
        assert {tuple(r)[1:] for r in found if r["path"] == path} == by_grammar(text), path
    assert {r["path"] for r in found} == set(texts) - {"plain.py"}
    assert rows.columns == scopes.SCHEMA
    assert not scopes.indented(spark.createDataFrame([], SCHEMA)).collect()


TS = """// class No {
import { a } from "b{";
export interface Shape {
  area(): number;
}
enum Kind { A, B }
export type Pair = [number, string];
export default class Store extends Base {
  static name = `class Neither {`;
  constructor(private x: number) {
    super(x);
    if (x) {
      helper(x);
    }
  }
  async get({ id }: Key): Promise<X> {
    const pick = (y) => {
      return y;
    };
    return pick(id);
  }
  empty() {}
}
/* function nor() {
} */
export async function load(
  x = {},
  y,
) {
  function inner() {
    return 1;
  }
  return inner();
}
const twice = (x: number) => x * 2;
describe("it", () => {
  function late() {
    return 2;
  }
});
"""


def test_braced(spark):
    rows = scopes.braced(spark.createDataFrame([("a.ts", TS), ("none.js", None), ("open.js", "function f() {\n  return 1\n")], SCHEMA))
    assert got(rows, "a.ts") == {
        ("Shape", "interface", "Shape", 3, 5), ("Kind", "enum", "Kind", 6, 6), ("Pair", "type_alias", "Pair", 7, 7), ("Store", "class", "Store", 8, 23),
        ("constructor", "method", "Store.constructor", 10, 15), ("get", "method", "Store.get", 16, 21), ("pick", "function", "Store.get.pick", 17, 19), ("empty", "method", "Store.empty", 22, 22),
        ("load", "function", "load", 26, 34), ("inner", "function", "load.inner", 30, 32), ("twice", "function", "twice", 35, 35), ("late", "function", "late", 37, 39),
    }
    assert got(rows, "open.js") == {("f", "function", "f", 1, 2)}


def test_methods_carry_the_header_of_their_class(spark):
    df = spark.createDataFrame([("a.ts", TS), ("b.py", "class A(B):\n    def m(self):\n        return 1\n\ndef f():\n    pass\n")], SCHEMA)
    table = scopes.braced(df.where("path = 'a.ts'")).union(scopes.indented(df.where("path = 'b.py'")))
    chunks = {(r["path"], r["qualified"]): r["content"] for r in code.code_chunks(df, table, headers=True).collect()}
    assert chunks["b.py", "A.m"] == "class A(B):\n    def m(self):\n        return 1"
    assert chunks["b.py", "f"] == "def f():\n    pass"
    assert chunks["a.ts", "Store.empty"] == "export default class Store extends Base {\n  empty() {}"

"""Nested symbols: intervals, kinds, parents, and brackets that don't count."""

from mnemodex.operators import sectioning, symbols

CODE = '''import type Row from "row" // class Gone {
export class Store extends Base<{ a: number }> {
    private rows: Row[] = []
    constructor(readonly name: string) {
        super(name)
        if (name) {
            log("{ not a brace")
        }
    }
    /* function hidden() {
    } */
    async load<T>(at: { id: string }): { row: T } | null {
        function inner() { return `}
        }` }
        return inner()
    }
    abstract none(): void;
}
type Pair = [string, string];
type Shape = {
    side: number
}
enum Kind { A, B }
function over(a: string): void;
const text = 'it\\'s }'
function over(a: string) {
    interface Local { x: number }
}
'''


def rows(spark, *texts):
    files = spark.createDataFrame([(f"f{i}.ts", t, "x") for i, t in enumerate(texts)], "path string, text string, kind string")
    return symbols.symbols(files).orderBy("path", "index").collect()


def test_symbols_nest(spark):
    got = [(r.anchor, r.kind, r.parent, r.exported, r.start_line, r.end_line) for r in rows(spark, CODE)]
    assert got == [
        ("Store", "class", None, True, 2, 18),
        ("constructor", "method", "Store", True, 4, 9),
        ("load", "method", "Store", True, 12, 16),
        ("inner", "function", "load", True, 13, 14),
        ("Pair", "type", None, False, 19, 19),
        ("Shape", "type", None, False, 20, 22),
        ("Kind", "enum", None, False, 23, 23),
        ("over", "function", None, False, 26, 28),
        ("Local", "interface", "over", False, 27, 27),
    ]


def test_content_is_the_lines_of_the_interval(spark):
    lines = CODE.split("\n")
    for r in rows(spark, CODE):
        assert r.content == "\n".join(lines[r.start_line - 1 : r.end_line])


def test_other_languages(spark):
    go = "package a\n\ntype User struct {\n\tName string\n}\n\nfunc (u *User) Rename(to string) {\n\tu.Name = to\n}\nfunc main() {\n}\n"
    rust = "pub struct Point;\npub trait Draw {\n    fn draw(&self) {\n    }\n}\nmod shapes {\n  fn area() {}\n}\n"
    got = [(r.anchor, r.kind, r.parent, r.start_line, r.end_line) for r in rows(spark, go, rust)]
    assert got == [
        ("User", "type", None, 3, 5), ("Rename", "method", None, 7, 9), ("main", "function", None, 10, 11),
        ("Point", "struct", None, 1, 1), ("Draw", "trait", None, 2, 5), ("draw", "function", "Draw", 3, 4), ("shapes", "module", None, 6, 8), ("area", "function", "shapes", 7, 7),
    ]


def test_open_bodies_and_odd_texts(spark):
    got = rows(spark, "class A {\n  go() {\n    run(", None, "", "} } just ) text {", "call(x)\nif (y) {\n  function z() {}\n}", "class " + "a b " * 20000 + "\n" + "x(" * 20000 + '"' * 5001)
    assert [(r.path, r.anchor, r.parent, r.start_line, r.end_line) for r in got] == [("f0.ts", "A", None, 1, 3), ("f0.ts", "go", "A", 2, 3), ("f4.ts", "z", None, 3, 3), ("f5.ts", "a", None, 1, 1)]
    assert not rows(spark, None)


def test_sections_by_symbols(spark):
    files = spark.createDataFrame([("src/a.ts", "export class A {\n  go() {\n  }\n}\n"), ("src/b.ts", "run()\n"), ("c.md", "# T\nx")], "path string, text string")
    got = [(r.path, r["index"], r.anchor, r.content) for r in sectioning.sections(files, nested=True).orderBy("path", "index").collect()]
    assert got == [("c.md", 0, "t", "# T\nx"), ("src/a.ts", 0, "A", "export class A {\n  go() {\n  }\n}"), ("src/a.ts", 1, "go", "  go() {\n  }"), ("src/b.ts", 0, "file", "run()\n")]
    assert {r.anchor for r in sectioning.sections(files).filter("path = 'src/a.ts'").collect()} == {"A"}

"""Extractors on tokens: cases written by hand."""

import pytest

from weftgraph.operators import enrich, lexer

JAVA = '''
/* class Wrong { void no() { gone(); } } */
public class Shop extends Base<Map<String, List<Item>>> implements Runnable, Store<Cart> {
  private final String text = "} void fake() { hidden(); } {";
  private char brace = '{';
  String block = """
    } void other() { absent(); }
    """;
  public Shop(int n) { super(n); prepare(); }
  @Override
  public <T extends Comparable<T>> List<T> sort(List<T> xs) throws IOException, OtherException {
    // } unseen();
    if (ready()) { return helper.apply(xs); }
    Runnable r = new Runnable() { public void run() { inner(); } };
    return xs.stream().map(x -> { return convert(x); }).toList();
  }
  abstract void open();
  void after() { last(); }
}
interface Named extends One, Two { }
enum Size implements Sized { A { void f() { x(); } }, B; void g() { y(); } }
'''
GO = '''package m

import "fmt"

var _ io.Reader = (*File)(nil)
var _ Writer = &File{}

type Pair struct { a, b int }

func (f *File) Read(p []byte) (n int, err error) {
	s := `} func no() { gone() } {`
	fmt.Println("}", s) // } unseen()
	return f.inner(p)
}

func plain(x interface{ Do() }, y struct{ z int }) map[string]struct{} {
	go func() { spawned() }()
	return build(x)
}

func Map[T any](xs []T) []T { return apply(xs) }

func empty() {}
'''
TS = '''
// function no() { gone(); }
import { a } from "x";
export class Cart<T extends Item> extends Base<T> implements Store, Named {
  private text = `} ${"{"} fake() {`;
  constructor(private x: number) { super(); setUp(x); }
  async load(id: string): Promise<{ a: number }> {
    const re = /[{}]\\/(/g;
    return fetchIt(id).then((r) => { return parse(r); });
  }
  get total(): number { return sum(this.items); }
}
function plain({ a, b }: { a: number; b: string }): void { run(a / b / 2); }
export const arrow = async (x: number): Promise<void> => { await go(x); };
const small = (x) => { tiny(x); };
export function second(): void {
  if (ready()) { done(); }
}
export type Id = string;
export interface Named { name: string }
export default small;
export { a };
'''


def found(language, text):
    out = {}
    for name, _, called in lexer.calls(language, text):
        out.setdefault(name, []).append(called)
    return out


def test_java_calls():
    assert found("java", JAVA) == {"Shop": ["prepare"], "sort": ["ready", "apply", "Runnable", "inner", "stream", "map", "convert", "toList"], "run": ["inner"], "after": ["last"], "f": ["x"], "g": ["y"]}
    assert [(n, line) for n, line, c in lexer.calls("java", JAVA) if c == "last"] == [("after", 18)]


def test_go_calls():
    assert found("go", GO) == {"Read": ["Println", "inner"], "plain": ["spawned", "build"], "Map": ["apply"]}


def test_typescript_calls():
    assert found("typescript", TS) == {"constructor": ["setUp"], "load": ["fetchIt", "then", "parse"], "total": ["sum"], "plain": ["run"], "arrow": ["go"], "small": ["tiny"], "second": ["ready", "done"]}


@pytest.mark.parametrize("language", ["java", "go", "typescript"])
@pytest.mark.parametrize("text", ["", "}}{{not valid {{{", '"', "'", "`", "/*", "class", "func (", "export", "a(b", ")))", "class A { void f( {", "export const", "func f() interface{"])
def test_broken_sources(language, text):
    assert lexer.calls(language, text) == []
    lexer.type_relations(language, text)
    lexer.module_exports(text)


def test_types():
    assert lexer.type_relations("java", JAVA) == [("Shop", "extends_type", "Base<Map<String, List<Item>>>"), ("Shop", "implements_types", "Runnable, Store<Cart>"), ("Named", "extends_type", "One, Two"), ("Size", "implements_types", "Sized")]
    assert lexer.type_relations("typescript", TS)[:2] == [("Cart", "extends_type", "Base<T>"), ("Cart", "implements_types", "Store, Named")]
    assert lexer.type_relations("go", GO) == [("File", "implements_types", "io.Reader"), ("File", "implements_types", "Writer")]
    assert lexer.type_relations("java", "class Foo extends Bar implements Baz, Qux {}") == [("Foo", "extends_type", "Bar"), ("Foo", "implements_types", "Baz, Qux")]
    assert lexer.type_relations("java", "class X {}") == []


def test_exports():
    got = lexer.module_exports(TS)
    assert [x.split("(")[0].split("{")[0].strip() for x in got] == ["class Cart<T extends Item> extends Base<T> implements Store, Named", "const arrow = async", "function second", "type Id = string", "interface Named"]
    assert got[1] == "const arrow = async (x: number): Promise<void> => { await go(x); }" and got[2].endswith("done(); }\n}")
    assert lexer.module_exports("export const x = 1\nexport const y = 2;") == ["const x = 1", "const y = 2"]
    assert enrich.exports("python", 'x = 1\n__all__ = ["alpha", \'beta\',  # more\n  "gamma",\n]\n') == [("all_exports", "alpha, beta, gamma")]
    assert enrich.exports("python", "x = 1") == enrich.exports("go", "export const x = 1") == []


def test_exports_reach_module_nodes(spark):
    from weftgraph import model as M

    node = lambda i, kind, label, path, **props: (i, kind, label, "", path, 1, 1, "", "", "", "", [], props)
    nodes = spark.createDataFrame([node("m", "module", "a.ts", "a.ts"), node("p", "module", "b.py", "b.py", all_exports="own"), node("t", "module", "c.ts", "c.ts", file_type="test"), node("c", "class", "K", "a.ts")], M.NODES)
    files = spark.createDataFrame([("a.ts", "typescript", "export class K extends L {}"), ("b.py", "python", "__all__ = ['x']"), ("c.ts", "typescript", "export type T = 1;")], "path string, language string, content string")
    got = {r["id"]: r["props"] for r in enrich.with_types(nodes, files).collect()}
    assert got == {"m": {"module_exports": "class K extends L {}"}, "p": {"all_exports": "own"}, "t": {"file_type": "test"}, "c": {"extends_type": "L"}}


def test_packed_scripts_and_tests_are_left_out(spark):
    long = "function f(){g();}" * 4000
    files = spark.createDataFrame([("a.js", "typescript", long), ("b.js", "typescript", long.replace("}", "}\n")), ("c.java", "java", "class A { void f() { g(); } }" + " " * 60_000)], "path string, language string, content string")
    assert sorted(r["path"] for r in enrich.source_files(files).collect()) == ["b.js", "c.java"]

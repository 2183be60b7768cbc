import pytest

from tarnwork.sources.code import parse_sources, quiet, scanned_facts

RUST = '''
use crate::db::{Pool,
    Row};
pub const MAX: u32 = 10; // fn no() {}
pub struct Store { pub rows: Vec<Row>,
    size: usize,
}
impl Store {
    /* fn gone() { lost(); } */
    pub(crate) async unsafe fn load<'a, T: Into<String>, F: Fn(u8) -> u8>(
        &mut self,
        name: T, map: HashMap<String, u8>,
    ) -> Result<Option<Row>, Error>
    where T: Clone
    {
        let text = "open(\\"{\\") }";
        self.pool.get(name.into());
        fetch(1).await;
        println!("{}", text);
        let c = |x| inner(x);
    }
    fn swap(a: &mut Row) -> Option<Row> { std::mem::swap(a, b) }
}
fn after() {}
static NAME: &str = outside("x");
'''
GO = '''package main
import (
\t"fmt"
\tlog "os/log"
)
const Limit = 10
type Pool struct {
\tsize int
}
func (p *Pool) Run[T any](n int, names map[string]int) (int, error) {
\tgo work(n)
\tdefer p.close()
\tfmt.Println("call(me)")
\treturn helper(n), nil
}
func small() { }
var x = outside()
'''
TS = '''import { a } from './a';
export const LIMIT = 3;
export class Store extends Base {
  private size: number = 0;
  public async load<T, U>(key: string, more?: () => void): Promise<T | undefined> {
    const v = await this.db.get(key);
    return new Row(v);
  }
  static make(): Store { return build(); }
}
export const pick = async (a: number, b: string): Promise<void> => { use(a); };
function plain(x) { return x ? deep(x) : null; }
'''
CPP = '''#include <vector>
template <typename T, int N>
T Store::get(const T& key, int n) const { helper(n); delete old; return T(); }
class Store { public: int size; ~Store() { free_all(); } };
void run(int *p) { auto s = new Store(1); s->go_on(); }
'''
SOL = '''import "./a.sol";
contract Vault is Base {
    uint256 public constant FEE = 5;
    function pay(address to, uint n) public payable returns (bool) { unchecked { n += 1; } token.send(to, n); return check(n); }
    function hide() internal {}
}
'''


def by(path, source, language):
    return scanned_facts(path, source, language)


def function(facts, name):
    return next(f for f in facts if f.kind == "function" and f.name == name)


def calls(facts, inside):
    return {(f.name, f.detail) for f in facts if f.kind == "call" and f.container == inside}


def names(facts, kind):
    return [f.name for f in facts if f.kind == kind]


def test_rust():
    facts = by("a.rs", RUST, "rust")
    assert names(facts, "function") == ["load", "swap", "after"] and names(facts, "import") == ["crate::db::{Pool, Row}"]
    load, swap = function(facts, "load"), function(facts, "swap")
    assert (load.is_public, load.is_async, load.is_unsafe, load.takes_mut_self, load.takes_mut_params, load.returns_result, load.returns_option, load.generic_count) == (True, True, True, True, False, True, True, 3)
    assert load.parameters == ["&mut self", "name: T", "map: HashMap<String, u8>"] and load.returns == "Result<Option<Row>, Error>" and load.line == 10
    assert swap.takes_mut_params and not swap.takes_mut_self and not swap.is_public and not swap.returns_result and swap.returns_option
    assert calls(facts, "load") == {("self.pool.get", "method"), ("name.into", "method"), ("fetch", "async"), ("println!", "macro"), ("inner", "direct")}
    assert calls(facts, "swap") == {("std::mem::swap", "direct")} and not calls(facts, "after")
    assert "size" in names(facts, "member")
    assert [f.name for f in facts if f.kind == "constant"] == ["MAX", "NAME"]


def test_go():
    facts = by("a.go", GO, "go")
    run = function(facts, "Run")
    assert run.parameters == ["n int", "names map[string]int"] and run.returns == "(int, error)" and run.is_public and run.generic_count == 1 and not function(facts, "small").is_public
    assert calls(facts, "Run") == {("work", "goroutine"), ("p.close", "defer"), ("fmt.Println", "method"), ("helper", "direct")} and not calls(facts, "small")
    assert names(facts, "import") == ["fmt", "os/log"] and names(facts, "member") == ["size"] and names(facts, "constant") == ["Limit"]


def test_typescript():
    facts = by("a.ts", TS, "typescript")
    load = function(facts, "load")
    assert (load.container, load.is_async, load.is_public, load.takes_mut_self, load.returns_result, load.returns_option, load.generic_count) == ("Store", True, True, True, True, True, 2)
    assert load.parameters == ["key: string", "more?: () => void"]
    assert calls(facts, "load") == {("this.db.get", "async"), ("Row", "constructor")} and not function(facts, "make").takes_mut_self
    assert function(facts, "pick").is_async and function(facts, "pick").is_public and calls(facts, "pick") == {("use", "direct")} and calls(facts, "plain") == {("deep", "direct")}
    assert names(facts, "type") == ["Store"] and names(facts, "import") == ["./a"]


def test_cpp_and_c():
    facts = by("a.cpp", CPP, "cpp")
    get, run = function(facts, "Store::get"), function(facts, "run")
    assert get.generic_count == 2 and not get.takes_mut_self and get.takes_mut_params and calls(facts, "Store::get") == {("helper", "direct"), ("old", "destructor"), ("T", "direct")}
    assert calls(facts, "run") == {("Store", "constructor"), ("s->go_on", "method")} and run.takes_mut_params and calls(facts, "~Store") == {("free_all", "direct")}
    c = by("a.c", "#define N 3\nstatic int *first(char *s, int n) {\n  return next(s);\n}\nint late(void);\n", "c")
    first = function(c, "first")
    assert first.takes_mut_params and first.is_unsafe and not first.is_public and first.returns == "int *" and calls(c, "first") == {("next", "direct")} and names(c, "function") == ["first"]


def test_solidity():
    facts = by("a.sol", SOL, "solidity")
    pay = function(facts, "pay")
    assert pay.is_unsafe and pay.takes_mut_params and pay.is_public and pay.returns == "bool" and pay.container == "Vault" and not function(facts, "hide").is_public
    assert calls(facts, "pay") == {("token.send", "method"), ("check", "direct")} and names(facts, "constant") == ["FEE"]


def test_names_are_not_cut():
    long = "x." + "a" * 300
    facts = by("a.go", f"func f() {{\n {long}one()\n {long}two()\n}}\n", "go")
    assert names(facts, "call") == [long + "one", long + "two"]


@pytest.mark.parametrize("language", ["rust", "go", "javascript", "typescript", "solidity", "cairo", "c", "cpp"])
@pytest.mark.parametrize("text", ["", "fn", "fn f(", "func f(", "function f(a", "{{{", "}}}", '"', "/*", "class", "struct S {", "a(((((", "fn f<T(x) -> {", "\u0000'"])
def test_odd_texts_never_raise(language, text):
    scanned_facts("p", text, language)
    assert len(quiet(text, language)) == len(text)


def test_frame(spark):
    py = "class K:\n    async def go(self) -> Optional[int]:\n        await self.run()\n        return f(1)\n"
    rows = parse_sources(spark.createDataFrame([("a.rs", RUST), ("b.py", py), ("c.go", None), ("d.txt", "fn f() {}")], "path string, source string")).collect()
    go = next(r for r in rows if r["name"] == "go")
    assert go["takes_mut_self"] and go["returns_option"] and go["generic_count"] == 0 and go["line"] == 2
    assert {(r["name"], r["detail"]) for r in rows if r["path"] == "b.py" and r["kind"] == "call"} == {("self.run", "async"), ("f", "direct")}
    assert {r["path"] for r in rows} == {"a.rs", "b.py"}

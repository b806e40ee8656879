import textwrap

from memloom.sources.symbols import Registry

R = Registry()


def names(ext, source):
    return [(k.split("_")[0], n) for k, n, *_ in R.get(ext)(textwrap.dedent(source))]


def test_rust():
    source = '''
    /* fn no() { /* nested { */ } */
    pub(crate) async unsafe fn one<T: Into<String>, const N: usize>(x: &'a str, f: fn(i32) -> i32) -> [u8; 4] where T: Clone {
        let s = r#"fn no() { " }"#; let c = '{'; let d = b'\\''; let t = "\\"}";
        fn inner() {} struct Local { x: i32 }
        println!("{}", { fn macro_fn() {} 1 });
    }
    pub trait Shape<T> { fn area(&self) -> f64; fn name(&self) -> String { String::new() } }
    impl<'a, T> Shape<T> for X<'a> { #[inline] fn area(&self) -> f64 { 1.0 } }
    pub struct Unit; struct Tuple(i32, String); struct Named<T> where T: X { f: T }
    macro_rules! m { () => { fn no() {} } }
    extern "C" { fn foreign(x: i32); }
    mod inner { pub const fn deep() -> u8 { 1 } } fn r#type() {}
    '''
    assert names("rs", source) == [("function", "one"), ("function", "inner"), ("struct", "Local"), ("trait", "Shape"), ("function", "name"), ("function", "area"), ("struct", "Unit"), ("struct", "Tuple"), ("struct", "Named"), ("function", "deep"), ("function", "type")]
    rows = R.get("rs")("#[test]\npub\nfn a()\n{\n  b();\n}\nstruct S\n{\n}\nstruct T(\n u8\n);\n")
    assert rows == [("function_item", "a", 1, 5), ("struct_item", "S", 6, 8), ("struct_item", "T", 9, 11)]


def test_typescript():
    source = '''
    export interface A<T extends { x: number }> extends B { run(): void; f: () => { y: 1 } }
    export default class Box<T> extends Map<string, T> implements A {
      private readonly x: { a: number } = { a: 1 }
      static #count = 0; handler = async (e: Event) => { function inHandler() {} }
      constructor(private y: number, z = { m() {} }) { super() }
      get size(): number { return this.y }
      abstract no(): void;
      over(a: string): string;
      over(a: any): { ok: boolean } | null { if (a) { call(a) } return null }
      async *[Symbol.iterator]<K>(k?: K): AsyncIterator<Map<string, K[]>> { for (const a of b) { } }
      'quoted name'() { } @dec() decorated() { return /[}/{]/.test(`${f({ g() { return "}" } })} }`) }
    }
    abstract class Base { abstract f(): void; g() {} }
    type T1 = { m(): void }; type Fn = (x: number) => void
    declare function sig(x: number): void;
    export async function go<T>(x: T | undefined): Promise<T> { const o = { h() { }, i: function named() { }, j: class K { l() { } } }; return <T>x }
    function* gen() { function inGen() { } }
    namespace N { export function inN(): asserts x is string { } }
    const e = function f2() { }; (function f3() { })(); if (a) { while (b) { } } switch (x) { case 1: { f(); } default: { g() } }
    enum E { A = 1 } label: for (;;) { } const y = a < b, z = c > (d); export const k = class { n() { } }
    '''
    assert names("ts", source) == [("interface", "A"), ("class", "Box"), ("function", "inHandler"), ("method", "constructor"), ("method", "m"), ("method", "size"), ("method", "over"), ("method", "[Symbol.iterator]"), ("method", "'quoted name'"), ("method", "decorated"), ("method", "g"), ("method", "g"), ("function", "go"), ("method", "h"), ("method", "l"), ("function", "inGen"), ("function", "inN"), ("method", "n")]


def test_javascript_and_jsx():
    source = '''
    import React from "react"
    function App({ items }) {
      const text = `a ${items.map(i => { function inTemplate() {} return `${i}}` })} {`
      return <div className="x{" onClick={() => { function inJsx() {} }}>it's {items.map(i => <Item key={i} {...i} />)} don't {"}"} </div>
    }
    class List extends React.Component { state = { a: 1 }
      render() { return this.props.a ? <></> : <List.Item>{`}`}</List.Item> } }
    module.exports = { run() { }, async stop() { }, get size() { return 1 }, call: f(), ["x" + 1]() { } }
    export default function () { } ; var q = a / b / c; var r = x.class, s = { class: 1, function: 2 }
    if (x) function inIf() { }
    const f = async function g() { }
    '''
    for ext in ("js", "jsx"):
        assert sorted(names(ext, source)) == sorted([("function", "App"), ("function", "inTemplate"), ("function", "inJsx"), ("class", "List"), ("method", "render"), ("method", "run"), ("method", "stop"), ("method", "size"), ("method", '["x"+1]'), ("function", "inIf")])
    tsx = "const id = <T,>(x: T) => { function a() {} return <b>{x}</b> }\nfunction c() { return <p>}</p> }\n"
    assert names("tsx", tsx) == [("function", "a"), ("function", "c")]


def test_rows_and_broken_sources():
    assert R.get("js")("class A {\n  m() {\n  }\n\n  n(a,\n    b) { }\n}\n") == [("class_declaration", "A", 0, 6), ("method_definition", "m", 1, 2), ("method_definition", "n", 4, 5)]
    assert R.get("js")("function one() { return 1 } function two() { }") == [("function_declaration", "one", 0, 0), ("function_declaration", "two", 0, 0)]
    for ext in ("rs", "ts", "tsx", "js"):
        for source in ("", "{", "}", "fn", "class", "function f(", "class A { m() {", "`${", "/*", '"', "<div", "x = </", "interface I", "@", "fn a() { ((", "'", "async", "export default"):
            R.get(ext)(source)
    whole = "function a() { if (x) { } }\n" * 20_000
    assert len(R.get("ts")(whole)) == 20_000

import subprocess
import time

import pytest

from codelode.operators.extract import scan_sources
from codelode.sources.projects import Catalog, Project, find_config, git_diff, index_tree, workspaces
from codelode.streaming.ingest import watch_tree

SOURCES = {
    "a.ts": '''import { a, b as c } from "./x";
import D from 'd';
import * as ns from "ns";
const fs = require("fs");
/**
 * Greets someone.
 */
function greet(name: string): string {
  logger.info(name);
  return new Foo().bar(name);
}
export class Dog extends Animal {
  private age: number = 3;
  bark() {
    if (this.age) { greet("x }"); }
  }
}
export const arrow = (x: number) => x + 1;
export interface Shape { area: number }
export type T = string;
export * from "./y";
exports.late = 1;
''',
    "b.py": '''import os
import numpy as np
from x.y import a, b as c
from z import *
class MyView(View, Mixin):
    """A view."""
    def __init__(self):
        self.x = compute(1)

    def _hidden(self):
        return os.path.join("a")

# makes it
def top(a, b):
    return MyView()
''',
    "c.go": '''package main

import (
	"fmt"
	myhttp "net/http"
)

// Server serves.
type Server struct {
	Port int
}

type reader interface {
	Read() int
}

func (s *Server) Start(p int) error {
	fmt.Println("x")
	return nil
}

func New() *Server {
	return &Server{Port: 8080}
}
''',
    "d.rs": '''use std::collections::{HashMap, HashSet as HS};
use std::io::*;
pub struct Point { x: i32 }
pub trait Draw { fn draw(&self); }
impl Draw for Point {
    fn draw(&self) {
        println!("x");
        helper(1);
    }
}
fn helper(x: i32) -> i32 { x }
enum Color { Red }
''',
    "e.java": '''package com.x;
import java.util.List;
import java.io.*;
/** A dog. */
public class Dog extends Animal implements Pet, Friend {
    private String name;
    public Dog(String name) {
        this.name = name;
    }
    void bark() {
        System.out.println("w");
        Foo f = new Foo();
    }
}
''',
    "f.c": '''#include <stdio.h>
typedef struct node node_t;
struct point {
  int x;
};
enum color { RED };
static int helper(int a) {
  return printf("x");
}
int main(void)
{
  return helper(1);
}
''',
    "g.cpp": '''#include "a.h"
namespace app {
class Circle : public Base {
public:
  Circle(int r);
  double area() const { return compute(r); }
private:
  int r;
};
int run() {
  Circle* c = new Circle(1);
  return 0;
}
}
''',
    "/p/node_modules/x.js": "function hidden() {}",
    "notes.txt": "function none() {}",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [*SOURCES.items(), ("null.go", None), ("a.ts", SOURCES["a.ts"])]
    found = scan_sources(spark.createDataFrame(rows, "file string, content string"))
    return {k: [r.asDict() for r in v.collect()] for k, v in found.items()}


def test_symbols(scanned):
    got = {(r["file"], r["name"], r["kind"], r["is_exported"]) for r in scanned["symbols"]}
    want = {
        ("a.ts", "greet", "function", 0), ("a.ts", "Dog", "class", 1), ("a.ts", "age", "property", 0), ("a.ts", "bark", "method", 0), ("a.ts", "arrow", "function", 1), ("a.ts", "Shape", "interface", 1), ("a.ts", "T", "type", 1), ("a.ts", "late", "variable", 1),
        ("b.py", "MyView", "class", 1), ("b.py", "__init__", "method", 1), ("b.py", "_hidden", "method", 0), ("b.py", "top", "function", 1),
        ("c.go", "Server", "class", 1), ("c.go", "reader", "interface", 0), ("c.go", "Start", "method", 1), ("c.go", "New", "function", 1), ("c.go", "main", "variable", 1),
        ("d.rs", "Point", "class", 1), ("d.rs", "Draw", "interface", 1), ("d.rs", "helper", "function", 0), ("d.rs", "Color", "enum", 0),
        ("e.java", "Dog", "class", 1), ("e.java", "name", "property", 0), ("e.java", "bark", "method", 0), ("e.java", "com.x", "variable", 1),
        ("f.c", "node_t", "type", 1), ("f.c", "point", "class", 1), ("f.c", "color", "enum", 1), ("f.c", "helper", "function", 0), ("f.c", "main", "function", 1),
        ("g.cpp", "Circle", "class", 1), ("g.cpp", "area", "method", 0), ("g.cpp", "run", "function", 1), ("g.cpp", "app", "variable", 1),
    }
    assert want <= got
    assert not any(r["name"] in ("hidden", "none") for r in scanned["symbols"])
    assert len({(r["file"], r["ordinal"]) for r in scanned["symbols"]}) == len(scanned["symbols"])


def test_spans_parents_and_docs(scanned):
    at = {(r["file"], r["name"], r["kind"]): r for r in scanned["symbols"]}
    spans = {k: (r["line_start"], r["line_end"]) for k, r in at.items()}
    assert spans["a.ts", "greet", "function"] == (8, 11) and spans["a.ts", "Dog", "class"] == (12, 17) and spans["b.py", "MyView", "class"] == (5, 11) and spans["f.c", "main", "function"] == (10, 13)
    inner = at["a.ts", "bark", "method"]
    assert inner["parent_ordinal"] == at["a.ts", "Dog", "class"]["ordinal"] and at["b.py", "_hidden", "method"]["parent_ordinal"] == at["b.py", "MyView", "class"]["ordinal"]
    docs = {k[1]: r["docstring"] for k, r in at.items() if r["docstring"]}
    assert docs == {"greet": "Greets someone.", "MyView": "A view.", "top": "makes it", "Server": "Server serves.", "Dog": "A dog."}
    assert at["a.ts", "greet", "function"]["signature"] == "function greet(name: string): string"


def test_references(scanned):
    name = {(r["file"], r["ordinal"]): r["name"] for r in scanned["symbols"]}
    got = {(r["file"], name[r["file"], r["from_ordinal"]], r["to_symbol_name"], r["to_symbol_bare_name"], r["kind"]) for r in scanned["references"]}
    assert {
        ("a.ts", "greet", "logger.info", "info", "call"), ("a.ts", "greet", "Foo", "Foo", "instantiation"), ("a.ts", "Dog", "Animal", "Animal", "extends"), ("a.ts", "bark", "greet", "greet", "call"),
        ("b.py", "MyView", "View", "View", "extends"), ("b.py", "MyView", "Mixin", "Mixin", "extends"), ("b.py", "_hidden", "os.path.join", "join", "call"), ("c.go", "Start", "fmt.Println", "Println", "call"), ("c.go", "New", "Server", "Server", "instantiation"),
        ("d.rs", "draw", "helper", "helper", "call"), ("d.rs", "draw", "println", "println", "call"), ("d.rs", "Point", "Draw", "Draw", "implements"), ("e.java", "Dog", "Animal", "Animal", "extends"), ("e.java", "Dog", "Pet", "Pet", "implements"),
        ("e.java", "Dog", "Friend", "Friend", "implements"), ("e.java", "bark", "Foo", "Foo", "instantiation"), ("f.c", "main", "helper", "helper", "call"), ("g.cpp", "Circle", "Base", "Base", "extends"), ("g.cpp", "run", "Circle", "Circle", "instantiation"),
    } <= got


def test_imports(scanned):
    got = {(r["file"], r["source_path"], r["imported_name"], r["local_name"], r["is_default"], r["is_namespace"]) for r in scanned["imports"]}
    assert {
        ("a.ts", "./x", "a", "a", 0, 0), ("a.ts", "./x", "b", "c", 0, 0), ("a.ts", "d", "D", "D", 1, 0), ("a.ts", "ns", "*", "ns", 0, 1), ("a.ts", "fs", "*", "fs", 0, 1), ("a.ts", "./y", "*", "*", 0, 1),
        ("b.py", "os", "os", "os", 0, 1), ("b.py", "numpy", "numpy", "np", 0, 1), ("b.py", "x.y", "b", "c", 0, 0), ("b.py", "z", "*", "*", 0, 1), ("c.go", "fmt", "fmt", "fmt", 0, 0), ("c.go", "net/http", "net/http", "myhttp", 0, 0),
        ("d.rs", "std::collections", "HashSet", "HS", 0, 0), ("d.rs", "std::io", "*", "*", 0, 1), ("e.java", "java.util.List", "java.util.List", "List", 0, 0), ("e.java", "java.io", "*", "*", 0, 1), ("f.c", "stdio.h", "stdio.h", "stdio.h", 0, 1),
    } <= got


def test_tree_is_indexed_once(spark, tmp_path):
    (tmp_path / "src" / "dist").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("def f():\n    g()\n")
    (tmp_path / "src" / "dist" / "b.py").write_text("def hidden():\n    pass\n")
    first = index_tree(spark, [str(tmp_path), str(tmp_path / "src")])
    assert [r["name"] for r in first["symbols"].collect()] == ["f"] and first["files"].count() == 1
    again = index_tree(spark, [str(tmp_path)], first["files"])
    assert again["files"].count() == 0 and again["symbols"].count() == 0


def test_projects(tmp_path):
    c = Catalog(str(tmp_path / "c.json"))
    c.add(Project("one", ["/a"]))
    c.add(Project("two", ["/a/b"]))
    assert Catalog(str(tmp_path / "c.json")).active == "two" and c.for_folder("/a/b/c").name == "two" and c.for_folder("/a/bc").name == "one" and c.for_folder("/x") is None
    assert c.switch("one").roots == ["/a"]
    with pytest.raises(KeyError):
        c.switch("three")
    (tmp_path / ".codelode.json").write_text('{"name": "p", "roots": ["src"]}')
    (tmp_path / "src").mkdir()
    assert find_config(str(tmp_path / "src")).roots == [str(tmp_path / "src")]
    (tmp_path / "package.json").write_text('{"workspaces": ["packages/*"]}')
    assert workspaces(str(tmp_path)) == [str(tmp_path / "packages")]
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'libs/*'\n  - apps\n")
    assert workspaces(str(tmp_path)) == [str(tmp_path / "libs"), str(tmp_path / "apps")]


def test_git_diff(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\n")
    run("add", "-A")
    (tmp_path / "a.txt").write_text("two\n")
    assert "+two" in git_diff(spark, str(tmp_path)).first()["diff_text"]
    for bad in ("--output=x", "a b", "a;b"):
        with pytest.raises(ValueError):
            git_diff(spark, str(tmp_path), bad)


def test_watching(spark, tmp_path):
    seen = []
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    pass\n")
    query = watch_tree(spark, [str(tmp_path / "src")], lambda batch, n: seen.extend(r["file"] for r in batch.collect()), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(60)
    time.sleep(0.1)
    assert [s.rsplit("/", 1)[1] for s in seen] == ["a.py"]


@pytest.mark.parametrize("quote", ['"""', "'''"])
def test_docstrings_of_any_length(spark, quote):
    told = "\n".join(f"Line {i}." for i in range(500))
    text = f"# above\ndef long():\n    {quote}{told}\n    {quote}\n    return 1\n\n\ndef short():\n    {quote}One.{quote}\n    x = {quote}a\n    {quote}\n\n\n# above\ndef open_():\n    {quote}Never closed\n"
    docs = {r["name"]: r["docstring"] for r in scan_sources(spark.createDataFrame([("a.py", text)], "file string, content string"))["symbols"].collect()}
    assert docs["long"].split() == told.split() and docs["short"] == "One." and docs["open_"] == "above"

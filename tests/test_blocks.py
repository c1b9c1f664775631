"""Symbols of languages with blocks, each over a small source."""

import pytest

from lithoscan.operators import blocks

SOURCES = {
    "a.go": ('package a\n\ntype Job struct {\n\tname string\n}\n\ntype Doer interface {\n\tDo() error\n}\n\ntype ID int\n\nfunc (j *Job) Run(n int) string {\n\tif n > 0 {\n\t\treturn "}"\n\t}\n\treturn j.name\n}\n\nfunc Main() {\n\tRun(1)\n}\n',
             {("Job", "struct", 3, 5, None), ("Doer", "interface", 7, 9, None), ("ID", "type", 11, None, None), ("Run", "method", 13, 18, "Job"), ("Main", "function", 20, 22, None)}),
    "b.rs": ("pub struct Job {\n    name: String,\n}\n\nimpl Doer for Job {\n    pub fn run(&self, n: u32) -> String {\n        // a brace } in a comment\n        self.name.clone()\n    }\n}\n\ntrait Doer {\n    fn run(&self, n: u32) -> String;\n}\n\nenum Kind { A, B }\n\npub async fn main() {\n}\n",
             {("Job", "struct", 1, 3, None), ("run", "method", 6, 9, "Job"), ("Doer", "interface", 12, 14, None), ("run", "method", 13, 13, "Doer"), ("Kind", "enum", 16, 16, None), ("main", "function", 18, 19, None)}),
    "C.java": ("package c;\n\npublic class Job implements Doer {\n    private final String name;\n\n    public Job(String name) {\n        this.name = name;\n    }\n\n    public static <T> List<T> run(int n) throws IOException {\n        if (n > 0) {\n            return other(n);\n        }\n        return null;\n    }\n\n    enum Kind { A, B }\n}\n\ninterface Doer {\n    void run(int n);\n}\n",
               {("Job", "class", 3, 18, None), ("Job", "method", 6, 8, "Job"), ("run", "method", 10, 15, "Job"), ("Kind", "enum", 17, 17, "Job"), ("Doer", "interface", 20, 22, None)}),
    "d.c": ('#include <stdio.h>\n\nstruct job {\n    int n;\n};\n\nenum kind { A, B };\n\nint declared(int n);\n\nstatic int run(struct job *j,\n               int n)\n{\n    if (n) { printf("{"); }\n    return declared(n);\n}\n\nint main(void) {\n    return run(0, 1);\n}\n',
            {("job", "struct", 3, 5, None), ("kind", "enum", 7, 7, None), ("run", "function", 11, 16, None), ("main", "function", 18, 20, None)}),
    "e.cpp": ("namespace work {\nclass Job : public Base {\npublic:\n    int run(int n) { return n; }\n    void later();\n};\n\nvoid Job::later() {\n}\n}\n",
              {("work", "module", 1, 10, None), ("Job", "class", 2, 6, "work"), ("run", "method", 4, 4, "work.Job"), ("later", "function", 8, 9, "Job")}),
    "f.rb": ("module Work\n  class Job\n    def run(n)\n      if n\n        1\n      end\n    end\n\n    def self.make = new\n  end\nend\n",
             {("Work", "module", 1, 11, None), ("Job", "class", 2, 10, "Work"), ("run", "method", 3, 7, "Work.Job"), ("make", "method", 9, 9, "Work.Job")}),
    "g.ts": ("export class Job {\n  private name = '{';\n  async run(n: number): Promise<string> {\n    if (n) {\n      return call(n);\n    }\n  }\n}\n\nexport const go = (n: number) => {\n  return n;\n};\n\nfunction main() {\n}\n\ninterface Doer {\n  run(): void;\n}\n",
             {("Job", "class", 1, 8, None), ("run", "method", 3, 7, "Job"), ("go", "function", 10, 12, None), ("main", "function", 14, 15, None), ("Doer", "interface", 17, 19, None)}),
    "h.lua": ("local function run(n)\n  if n then\n    return 1\n  end\nend\n\nfunction Job:go()\nend\n", {("run", "function", 1, 5, None), ("go", "function", 7, 8, "Job")}),
    "i.sh": ("#!/bin/bash\nrun() {\n  echo ${1} # }\n}\nfunction other {\n  run\n}\n", {("run", "function", 2, 4, None), ("other", "function", 5, 7, None)}),
}


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_symbols_of_a_language(path):
    text, want = SOURCES[path]
    assert {(n, k, a, z, s) for n, _, a, z, k, _, s, _ in blocks.file_tags(path, text)} == want


def test_tags_of_many_files(spark):
    rows = [(p, t) for p, (t, _) in SOURCES.items()] + [("j.go", None), ("k.rs", ""), ("l.java", "}}}\n{"), ("m.txt", "class X {"), ("n.py", "class Y: pass")]
    got = blocks.block_tags(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {(r.path, r.name, r.kind, r.line, r.end, r.scope) for r in got} == {(p, n, k, a, z, s) for p, (_, w) in SOURCES.items() for n, k, a, z, s in w}
    assert next(r.signature for r in got if r.path == "a.go" and r.name == "Run") == "(n int)"

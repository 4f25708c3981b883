"""Line-scanner edge cases (ledger Q6, Q7, Q10, Q11, Q12, Q22, Q23) on literal sources."""

from codelake.operators import cpp as C
from codelake.operators import cs as CS
from codelake.operators import js as J
from codelake.operators import svelte as SV
from codelake.operators.lines import src_lines
from conftest import files_df

CPP = """#include "a.h"
#include <map>
namespace outer {
namespace inner {
int proto(int a);
class Foo : public Bar {
  int hidden(int z) { return z; }
};
}
int after(const T* p, int& q) {
  if (p) {
    return run(q);
  } else if (q) {
  }
}
}
int g = 1;
"""


def test_cpp_namespaces_close_and_prototypes(spark):
    acc = C.cpp_scan(src_lines(files_df(spark, [("r", "a.cpp", CPP)])))
    fns = {r.name: r for r in C.cpp_functions(acc).collect()}
    assert set(fns) == {"outer::inner::proto", "outer::after"}        # Q10 pop, Q11 keywords
    assert (fns["outer::inner::proto"].line_start, fns["outer::inner::proto"].line_end) == (5, 5)
    assert (fns["outer::after"].line_start, fns["outer::after"].line_end) == (10, 15)
    assert [(a.name, a.type) for a in fns["outer::after"].args] == [("p", "const T*"), ("q", "int&")]
    cls = C.cpp_classes(acc).collect()
    assert [(c.name, list(c.base_classes), c.line_end) for c in cls] == [("outer::inner::Foo", ["Bar"], 8)]
    assert [(v.name, v.scope) for v in C.cpp_variables(acc).collect()] == [("g", "global")]
    assert [i.module for i in C.cpp_includes(acc).collect()] == ["a.h"]


CS_SRC = """using System;
namespace App {
[Serializable, Obsolete]
[Table]
public sealed class Shop : Base, IShop {
  [Required]
  public string Name { get; set; }
  private int count = 3;
  public static List<int> Items(int a, out string b) {
    int local = 1;
    return null;
  }
}
}
"""


def test_cs_attributes_members_and_methods(spark):
    acc = CS.cs_scan(src_lines(files_df(spark, [("r", "S.cs", CS_SRC)])))
    t = CS.cs_types(acc).collect()
    assert [(x.name, list(x.base_classes), x.docstring, x.line_start, x.line_end) for x in t] == [
        ("App.Shop", ["Base", "IShop"], "Class with attributes: Serializable, Obsolete, Table", 5, 13)]
    m = {r.name: r for r in CS.cs_members(acc).collect()}
    assert set(m) == {"Name", "count"}                                   # body of Items is consumed
    assert m["Name"].docstring == "Member with attributes: Required" and m["Name"].scope == "class"
    assert m["count"].value == "3"
    meth = CS.cs_methods(acc).collect()
    assert [(x.name, x.owner_class, [(a.name, a.type) for a in x.args]) for x in meth] == [
        ("Items", "Shop", [("a", "int"), ("b", "string")])]


JS = """import Default from "./dflt";
import './side-effect.css';
/** A shape */
class Shape extends Base {
}
/**
 * @param {number} w width
 * @return {number} area
 */
function area(w, h) { return w * h; }
const y = require('../up/y');
"""


def test_js_definitions_after_jsdoc(spark):
    jl = J.js_lines(src_lines(files_df(spark, [("r", "src/a.js", JS)])))
    fns, cls = J.js_definitions(jl)
    assert [(c.name, list(c.base_classes), c.docstring) for c in cls.collect()] == [("Shape", ["Base"], "/** A shape")]
    f = fns.collect()[0]
    # '@return' (no s) fails the '@returns' prefix check, as in the analysed tool
    assert (f.name, [(a.name, a.type) for a in f.args], f.returns) == ("area", [("w", "number"), ("h", None)], None)
    imps = {r.module: list(r.names) for r in J.js_imports(jl).collect()}
    assert imps == {"./dflt": ["Default"], "../up/y": ["y"]}
    deps = sorted(r.dependency for r in J.js_raw_dependencies(src_lines(files_df(spark, [("r", "src/a.js", JS)]))).collect())
    assert deps == ["../up/y", "./dflt"]


SVELTE = """<script context="module">
import A from './A.svelte';
</script>
<h1 on:click={a} on:keydown={b}>t</h1><style>h1{}</style><p on:focus={c}>x</p>
{#each rows as r}{/each}
"""


def test_svelte_template_lines_are_file_lines(spark):
    f = files_df(spark, [("r", "C.svelte", SVELTE)])
    handlers, variables = SV.svelte_facts(f)
    assert sorted((h.name, h.line_start) for h in handlers.collect()) == [
        ("on_click", 4), ("on_focus", 4), ("on_keydown", 4)]
    assert [(v.name, v.scope, v.line_start) for v in variables.collect()] == [("rows", "template", 5)]
    assert [r.dependency for r in SV.svelte_raw_dependencies(f).collect()] == ["./A.svelte"]

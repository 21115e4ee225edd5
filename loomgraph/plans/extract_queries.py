"""Queries for extractors: a file made from every row of ``part``, and the nodes, edges, calls and values that must come of it, stated from the table.

The rows were taken from the extractors' output for one file each, read through, and written down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.registry import query
from loomgraph.sources import extract

#: name: (path, text, rows (kind, id or source or caller, label or target or callee or value, relation)); ``{k}`` is a row's number.
CASES: dict[str, tuple[str, str, tuple[tuple[str, str, str, str], ...]]] = {
    "python": (
        'src/m{k}.py',
        '"""What this module is about, at length."""\nimport os\nfrom . import z{k}\nfrom ..a import b\nclass K{k}(Base):\n    def run(self, cb):\n        helper(cb, other)\n        return cb\ndef helper(x, y):\n    # NOTE: kept because callers of part {k} need it\n    def inner():\n        deep{k}()\n    return inner\nTABLE = {"key": helper}\nhelper(1, 2)\n',
        (
            ('node', 'src_m{k}', 'm{k}.py', ''),
            ('node', 'src_m{k}_rationale', 'What this module is about, at length.', ''),
            ('edge', 'src_m{k}_rationale', 'src_m{k}', 'rationale_for'),
            ('edge', 'src_m{k}', 'os', 'imports'),
            ('edge', 'src_m{k}', 'src_z{k}', 'imports_from'),
            ('edge', 'src_m{k}', 'a', 'imports_from'),
            ('node', 'src_m{k}_k{k}', 'K{k}', ''),
            ('edge', 'src_m{k}', 'src_m{k}_k{k}', 'contains'),
            ('call', 'src_m{k}_k{k}', 'Base', 'inherits'),
            ('node', 'src_m{k}_k{k}_run', '.run()', ''),
            ('edge', 'src_m{k}_k{k}', 'src_m{k}_k{k}_run', 'method'),
            ('call', 'src_m{k}_k{k}_run', 'helper', 'calls'),
            ('call', 'src_m{k}_k{k}_run', 'other', 'indirect_call'),
            ('node', 'src_m{k}_helper', 'helper()', ''),
            ('edge', 'src_m{k}', 'src_m{k}_helper', 'contains'),
            ('call', 'src_m{k}_helper', 'inner', 'indirect_call'),
            ('node', 'src_m{k}_helper_inner', 'inner()', ''),
            ('edge', 'src_m{k}_helper', 'src_m{k}_helper_inner', 'contains'),
            ('call', 'src_m{k}_helper_inner', 'deep{k}', 'calls'),
            ('call', 'src_m{k}', 'helper', 'indirect_call'),
            ('call', 'src_m{k}', 'helper', 'calls'),
            ('node', 'src_m{k}_helper_rationale_10', 'kept because callers of part {k} need it', ''),
            ('edge', 'src_m{k}_helper_rationale_10', 'src_m{k}_helper', 'rationale_for'),
        ),
    ),
    "yaml": (
        'k/app{k}.yaml',
        'apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: website_{k}\nspec:\n  template:\n    name: podcasts_{k}\n---\nsteps:\n- alias: first {k}\n  uses: light.kitchen_{k}\n- two\n',
        (
            ('node', 'k_app{k}', 'app{k}.yaml', ''),
            ('value', 'k_app{k}', 'metadata', ''),
            ('value', 'k_app{k}', 'website_{k}', ''),
            ('value', 'k_app{k}', 'template', ''),
            ('value', 'k_app{k}', 'podcasts_{k}', ''),
            ('value', 'k_app{k}', 'light.kitchen_{k}', ''),
            ('node', 'k_app{k}_0_resource', 'Deployment website_{k}', ''),
            ('edge', 'k_app{k}', 'k_app{k}_0_resource', 'contains'),
            ('node', 'k_app{k}_0_apiversion', 'apiVersion', ''),
            ('edge', 'k_app{k}', 'k_app{k}_0_apiversion', 'contains'),
            ('node', 'k_app{k}_0_kind', 'kind', ''),
            ('edge', 'k_app{k}', 'k_app{k}_0_kind', 'contains'),
            ('node', 'k_app{k}_0_metadata', 'metadata', ''),
            ('edge', 'k_app{k}', 'k_app{k}_0_metadata', 'contains'),
            ('node', 'k_app{k}_0_metadata_name', 'name', ''),
            ('edge', 'k_app{k}_0_metadata', 'k_app{k}_0_metadata_name', 'contains'),
            ('node', 'k_app{k}_0_spec', 'spec', ''),
            ('edge', 'k_app{k}', 'k_app{k}_0_spec', 'contains'),
            ('node', 'k_app{k}_0_spec_template', 'podcasts_{k}', ''),
            ('edge', 'k_app{k}_0_spec', 'k_app{k}_0_spec_template', 'contains'),
            ('node', 'k_app{k}_1_steps', 'steps', ''),
            ('edge', 'k_app{k}', 'k_app{k}_1_steps', 'contains'),
            ('node', 'k_app{k}_1_steps_0', 'first {k}', ''),
            ('edge', 'k_app{k}_1_steps', 'k_app{k}_1_steps_0', 'contains'),
            ('node', 'k_app{k}_1_steps_1', 'steps[1]', ''),
            ('edge', 'k_app{k}_1_steps', 'k_app{k}_1_steps_1', 'contains'),
        ),
    ),
    "kustomization": (
        'k{k}/kustomization.yaml',
        'resources:\n- ../base{k}\n- dep.yaml\n',
        (
            ('node', 'k{k}_kustomization', 'kustomization.yaml', ''),
            ('edge', 'k{k}_kustomization', 'base{k}_kustomization', 'imports'),
            ('edge', 'k{k}_kustomization', 'k{k}_dep', 'imports'),
        ),
    ),
    "cargo": (
        'c{k}/Cargo.toml',
        '[package]\nname = "crate{k}"\n[dependencies]\nserde = "1"\ninner{k} = "1"\n',
        (
            ('node', 'c{k}_cargo', 'Cargo.toml', ''),
            ('node', 'crate:crate{k}', 'crate{k}', ''),
            ('edge', 'crate:crate{k}', 'crate:inner{k}', 'crate_depends_on'),
            ('edge', 'crate:crate{k}', 'crate:serde', 'crate_depends_on'),
        ),
    ),
    "pyproject": (
        'p{k}/pyproject.toml',
        '[project]\nname = "pack{k}"\ndependencies = ["requests>=2.0", "own{k}[extra]==1; python_version<\'3.9\'"]\n',
        (
            ('node', 'p{k}_pyproject', 'pyproject.toml', ''),
            ('node', 'pkg_pack{k}', 'pack{k}', ''),
            ('edge', 'pkg_pack{k}', 'pkg_requests', 'depends_on'),
            ('edge', 'pkg_pack{k}', 'pkg_own{k}', 'depends_on'),
        ),
    ),
    "agent_package": (
        'p{k}/apm.yml',
        'name: pack{k}\ndependencies:\n  - one{k}\n  - two\n',
        (
            ('node', 'p{k}_apm', 'apm.yml', ''),
            ('node', 'pkg_pack{k}', 'pack{k}', ''),
            ('edge', 'pkg_pack{k}', 'pkg_one{k}', 'depends_on'),
            ('edge', 'pkg_pack{k}', 'pkg_two', 'depends_on'),
        ),
    ),
    "go_module": (
        'p{k}/go.mod',
        'module example.com/m{k}\n\nrequire (\n\tgithub.com/a/b{k} v1.2.3\n)\n',
        (
            ('node', 'p{k}_go', 'go.mod', ''),
            ('node', 'pkg_example_com_m{k}', 'example.com/m{k}', ''),
            ('edge', 'pkg_example_com_m{k}', 'pkg_github_com_a_b{k}', 'depends_on'),
        ),
    ),
    "maven": (
        'p{k}/pom.xml',
        '<project><parent><artifactId>top</artifactId></parent><artifactId>app{k}</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>lib{k}</artifactId></dependency></dependencies></project>',
        (
            ('node', 'p{k}_pom', 'pom.xml', ''),
            ('node', 'pkg_app{k}', 'app{k}', ''),
            ('edge', 'pkg_app{k}', 'pkg_lib{k}', 'depends_on'),
        ),
    ),
    "zig": (
        'z/m{k}.zig',
        'const std = @import("std");\nconst P{k} = struct {\n    pub fn area(self: P{k}) i32 {\n        return helper(self.x);\n    }\n};\nfn helper(x: i32) i32 {\n    return x;\n}\n',
        (
            ('node', 'z_m{k}', 'm{k}.zig', ''),
            ('node', 'z_m{k}_p{k}', 'P{k}', ''),
            ('edge', 'z_m{k}', 'z_m{k}_p{k}', 'contains'),
            ('node', 'z_m{k}_p{k}_area', '.area()', ''),
            ('edge', 'z_m{k}_p{k}', 'z_m{k}_p{k}_area', 'method'),
            ('node', 'z_m{k}_helper', 'helper()', ''),
            ('edge', 'z_m{k}', 'z_m{k}_helper', 'contains'),
            ('edge', 'z_m{k}', 'std', 'imports_from'),
            ('call', 'z_m{k}_p{k}_area', 'helper', 'calls'),
        ),
    ),
    "elixir": (
        'e/m{k}.ex',
        'defmodule A{k}.B do\n  alias C.D{k}\n  def run(x) do\n    go(x)\n  end\n  defp go(x), do: x\nend\n',
        (
            ('node', 'e_m{k}', 'm{k}.ex', ''),
            ('node', 'e_m{k}_a{k}_b', 'A{k}.B', ''),
            ('edge', 'e_m{k}', 'e_m{k}_a{k}_b', 'contains'),
            ('node', 'e_m{k}_a{k}_b_run', '.run()', ''),
            ('edge', 'e_m{k}_a{k}_b', 'e_m{k}_a{k}_b_run', 'method'),
            ('node', 'e_m{k}_a{k}_b_go', '.go()', ''),
            ('edge', 'e_m{k}_a{k}_b', 'e_m{k}_a{k}_b_go', 'method'),
            ('edge', 'e_m{k}', 'c_d{k}', 'imports_from'),
            ('call', 'e_m{k}_a{k}_b_run', 'go', 'calls'),
        ),
    ),
    "robot": (
        'r/t{k}.robot',
        '*** Settings ***\nResource    ../r{k}.resource\nLibrary    Browser\n*** Test Cases ***\nLogin {k} Works\n    Open Page    x\n    ${a}=    Get Title\n*** Keywords ***\nOpen Page\n    Go To    x\n',
        (
            ('node', 'r_t{k}', 't{k}.robot', ''),
            ('edge', 'r_t{k}', 'r{k}', 'imports_from'),
            ('edge', 'r_t{k}', 'browser', 'imports_from'),
            ('node', 'r_t{k}_login_{k}_works', 'Login {k} Works', ''),
            ('edge', 'r_t{k}', 'r_t{k}_login_{k}_works', 'contains'),
            ('call', 'r_t{k}_login_{k}_works', 'Open Page', 'calls'),
            ('call', 'r_t{k}_login_{k}_works', 'Get Title', 'calls'),
            ('node', 'r_t{k}_open_page', 'Open Page()', ''),
            ('edge', 'r_t{k}', 'r_t{k}_open_page', 'contains'),
            ('call', 'r_t{k}_open_page', 'Go To', 'calls'),
        ),
    ),
    "apex": (
        'x/c{k}.cls',
        'public with sharing class Acc{k} extends Base {\n    public static void run(List<Id> ids) {\n        List<Account> a = [SELECT Id FROM Obj{k} LIMIT 1];\n        update a;\n        helper(a);\n    }\n}\n',
        (
            ('node', 'x_c{k}', 'c{k}.cls', ''),
            ('node', 'x_c{k}_acc{k}', 'Acc{k}', ''),
            ('edge', 'x_c{k}', 'x_c{k}_acc{k}', 'contains'),
            ('call', 'x_c{k}_acc{k}', 'Base', 'inherits'),
            ('node', 'x_c{k}_acc{k}_run', '.run()', ''),
            ('edge', 'x_c{k}_acc{k}', 'x_c{k}_acc{k}_run', 'method'),
            ('call', 'x_c{k}_acc{k}_run', 'helper', 'calls'),
            ('edge', 'x_c{k}_acc{k}_run', 'obj{k}', 'uses'),
            ('edge', 'x_c{k}_acc{k}_run', 'dml_update', 'uses'),
        ),
    ),
    "apex_trigger": (
        'x/t{k}.trigger',
        'trigger T{k} on Obj{k} (before insert) {\n    delete x;\n}\n',
        (
            ('node', 'x_t{k}', 't{k}.trigger', ''),
            ('node', 'x_t{k}_t{k}', 'T{k}', ''),
            ('edge', 'x_t{k}', 'x_t{k}_t{k}', 'contains'),
            ('edge', 'x_t{k}_t{k}', 'obj{k}', 'uses'),
            ('edge', 'x_t{k}', 'dml_delete', 'uses'),
        ),
    ),
    "razor": (
        'w/p{k}.razor',
        '@page "/p/{k}"\n@using A.B{k}\n@inject Svc{k} S\n<Box{k} x="1" />\n@code {\n    private void Load{k}() { }\n}\n',
        (
            ('node', 'w_p{k}', 'p{k}.razor', ''),
            ('edge', 'w_p{k}', 'box{k}', 'references'),
            ('edge', 'w_p{k}', 'a_b{k}', 'imports'),
            ('edge', 'w_p{k}', 'svc{k}', 'references'),
            ('edge', 'w_p{k}', 'route_p_{k}', 'references'),
            ('node', 'w_p{k}_load{k}', 'Load{k}()', ''),
            ('edge', 'w_p{k}', 'w_p{k}_load{k}', 'contains'),
        ),
    ),
    "blade": (
        'w/v{k}.blade.php',
        '@include(\'parts.head{k}\')\n<x-card{k} />\n<button wire:click="save{k}">\n',
        (
            ('node', 'w_v{k}_blade', 'v{k}.blade.php', ''),
            ('edge', 'w_v{k}_blade', 'parts_head{k}', 'includes'),
            ('edge', 'w_v{k}_blade', 'card{k}', 'uses_component'),
            ('edge', 'w_v{k}_blade', 'save{k}', 'binds_method'),
        ),
    ),
    "gherkin": (
        'f/l{k}.feature',
        'Feature: Login {k}\n  Scenario: Works\n    Given x\n  Scenario Outline: Fails {k}\n',
        (
            ('node', 'f_l{k}', 'l{k}.feature', ''),
            ('node', 'f_l{k}_login_{k}', 'Login {k}', ''),
            ('edge', 'f_l{k}', 'f_l{k}_login_{k}', 'contains'),
            ('node', 'f_l{k}_login_{k}_works', 'Works', ''),
            ('edge', 'f_l{k}_login_{k}', 'f_l{k}_login_{k}_works', 'contains'),
            ('node', 'f_l{k}_login_{k}_fails_{k}', 'Fails {k}', ''),
            ('edge', 'f_l{k}_login_{k}', 'f_l{k}_login_{k}_fails_{k}', 'contains'),
        ),
    ),
    "stylesheet": (
        's/a{k}.scss',
        "@import 'base{k}';\n.a{k} {\n  .b { color: red; }\n}\n@media print { .c{k} { x: y } }\n",
        (
            ('node', 's_a{k}', 'a{k}.scss', ''),
            ('node', 's_a{k}_a{k}', '.a{k}', ''),
            ('edge', 's_a{k}', 's_a{k}_a{k}', 'contains'),
            ('node', 's_a{k}_a{k}_b', '.b', ''),
            ('edge', 's_a{k}_a{k}', 's_a{k}_a{k}_b', 'contains'),
            ('node', 's_a{k}_media_print', '@media print', ''),
            ('edge', 's_a{k}', 's_a{k}_media_print', 'contains'),
            ('node', 's_a{k}_media_print_c{k}', '.c{k}', ''),
            ('edge', 's_a{k}_media_print', 's_a{k}_media_print_c{k}', 'contains'),
            ('edge', 's_a{k}', 'base{k}', 'imports_from'),
        ),
    ),
    "toml": (
        't/a{k}.toml',
        '[tool{k}]\nx = 1\n',
        (
            ('node', 't_a{k}', 'a{k}.toml', ''),
            ('node', 't_a{k}_tool{k}', 'tool{k}', ''),
            ('edge', 't_a{k}', 't_a{k}_tool{k}', 'contains'),
            ('node', 't_a{k}_tool{k}_x', 'x', ''),
            ('edge', 't_a{k}_tool{k}', 't_a{k}_tool{k}_x', 'contains'),
        ),
    ),
    "dockerfile": (
        'd{k}/Dockerfile',
        'FROM img{k} AS build\nFROM alpine\n',
        (
            ('node', 'd{k}_dockerfile', 'Dockerfile', ''),
            ('node', 'd{k}_dockerfile_build', 'build', ''),
            ('edge', 'd{k}_dockerfile', 'd{k}_dockerfile_build', 'contains'),
            ('edge', 'd{k}_dockerfile_build', 'img{k}', 'depends_on'),
            ('node', 'd{k}_dockerfile_stage1', 'stage1', ''),
            ('edge', 'd{k}_dockerfile', 'd{k}_dockerfile_stage1', 'contains'),
            ('edge', 'd{k}_dockerfile_stage1', 'alpine', 'depends_on'),
        ),
    ),
    "fish": (
        'f/a{k}.fish',
        'function go{k}\n    other x\nend\n',
        (
            ('node', 'f_a{k}', 'a{k}.fish', ''),
            ('node', 'f_a{k}_go{k}', 'go{k}()', ''),
            ('edge', 'f_a{k}', 'f_a{k}_go{k}', 'contains'),
            ('call', 'f_a{k}_go{k}', 'other', 'calls'),
        ),
    ),
    "shell": (
        'b{k}/a.sh',
        'source ./lib.sh\n. ../common{k}.sh\nfoo{k}() {\n  bar x\n}\n',
        (
            ('node', 'b{k}_a', 'a.sh', ''),
            ('node', 'b{k}_a_foo{k}', 'foo{k}()', ''),
            ('edge', 'b{k}_a', 'b{k}_a_foo{k}', 'contains'),
            ('call', 'b{k}_a_foo{k}', 'bar', 'calls'),
            ('edge', 'b{k}_a', 'b{k}_lib', 'imports_from'),
            ('edge', 'b{k}_a', 'common{k}', 'imports_from'),
        ),
    ),
    "java": (
        'j/T{k}.java',
        'import a.b.C{k};\npublic class T{k} extends Base implements I {\n  public int run(int x) {\n    return help(x);\n  }\n  private int help(int x) { return x; }\n}\n',
        (
            ('node', 'j_t{k}', 'T{k}.java', ''),
            ('node', 'j_t{k}_t{k}', 'T{k}', ''),
            ('edge', 'j_t{k}', 'j_t{k}_t{k}', 'contains'),
            ('call', 'j_t{k}_t{k}', 'Base', 'inherits'),
            ('call', 'j_t{k}_t{k}', 'I', 'inherits'),
            ('node', 'j_t{k}_t{k}_run', '.run()', ''),
            ('edge', 'j_t{k}_t{k}', 'j_t{k}_t{k}_run', 'method'),
            ('node', 'j_t{k}_t{k}_help', '.help()', ''),
            ('edge', 'j_t{k}_t{k}', 'j_t{k}_t{k}_help', 'method'),
            ('edge', 'j_t{k}', 'a_b_c{k}', 'imports_from'),
            ('call', 'j_t{k}_t{k}_run', 'help', 'calls'),
        ),
    ),
    "go": (
        'g/a{k}.go',
        'import "fmt"\ntype S{k} struct {\n  x int\n}\nfunc Run{k}() {\n  help()\n}\nfunc help() {\n}\n',
        (
            ('node', 'g_a{k}', 'a{k}.go', ''),
            ('node', 'g_a{k}_s{k}', 'S{k}', ''),
            ('edge', 'g_a{k}', 'g_a{k}_s{k}', 'contains'),
            ('node', 'g_a{k}_run{k}', 'Run{k}()', ''),
            ('edge', 'g_a{k}', 'g_a{k}_run{k}', 'contains'),
            ('node', 'g_a{k}_help', 'help()', ''),
            ('edge', 'g_a{k}', 'g_a{k}_help', 'contains'),
            ('edge', 'g_a{k}', 'fmt', 'imports_from'),
            ('call', 'g_a{k}_run{k}', 'help', 'calls'),
        ),
    ),
    "rust": (
        'r/a{k}.rs',
        'use std::io;\npub struct S{k} {\n    x: i32,\n}\npub fn go{k}() {\n    help();\n}\nfn help() {}\n',
        (
            ('node', 'r_a{k}', 'a{k}.rs', ''),
            ('node', 'r_a{k}_s{k}', 'S{k}', ''),
            ('edge', 'r_a{k}', 'r_a{k}_s{k}', 'contains'),
            ('node', 'r_a{k}_go{k}', 'go{k}()', ''),
            ('edge', 'r_a{k}', 'r_a{k}_go{k}', 'contains'),
            ('node', 'r_a{k}_help', 'help()', ''),
            ('edge', 'r_a{k}', 'r_a{k}_help', 'contains'),
            ('edge', 'r_a{k}', 'std_io', 'imports_from'),
            ('call', 'r_a{k}_go{k}', 'help', 'calls'),
        ),
    ),
    "javascript": (
        'j/x{k}.ts',
        "import {a} from './b{k}';\nexport class Foo{k} extends Bar {\n  run(x: number): void {\n    go(x);\n  }\n}\n",
        (
            ('node', 'j_x{k}', 'x{k}.ts', ''),
            ('node', 'j_x{k}_foo{k}', 'Foo{k}', ''),
            ('edge', 'j_x{k}', 'j_x{k}_foo{k}', 'contains'),
            ('call', 'j_x{k}_foo{k}', 'Bar', 'inherits'),
            ('node', 'j_x{k}_foo{k}_run', '.run()', ''),
            ('edge', 'j_x{k}_foo{k}', 'j_x{k}_foo{k}_run', 'method'),
            ('edge', 'j_x{k}', 'b{k}', 'imports_from'),
            ('call', 'j_x{k}_foo{k}_run', 'go', 'calls'),
        ),
    ),
    "test_blocks": (
        'j/x{k}.spec.ts',
        "describe('suite {k}', () => {\n  it('does', () => {});\n});\ntest(dynamic, () => {});\n",
        (
            ('node', 'j_x{k}_spec', 'x{k}.spec.ts', ''),
            ('node', 'j_x{k}_spec_test_l1_suite_{k}', 'suite {k}', ''),
            ('edge', 'j_x{k}_spec', 'j_x{k}_spec_test_l1_suite_{k}', 'contains'),
            ('node', 'j_x{k}_spec_test_l2_does', 'does', ''),
            ('edge', 'j_x{k}_spec', 'j_x{k}_spec_test_l2_does', 'contains'),
        ),
    ),
    "data_array": (
        'j/d{k}.js',
        "const L{k} = [\n {id:'a', title:'One {k}', x:1},\n {id:'b', title:'Two', x:1},\n {id:'c', title:'Three', x:1},\n];\nconst M = [\n {id:'a', title:'One', x:1},\n {id:'b', title:'Two', x:1},\n];\n",
        (
            ('node', 'j_d{k}', 'd{k}.js', ''),
            ('node', 'j_d{k}_l{k}', 'L{k}', ''),
            ('edge', 'j_d{k}', 'j_d{k}_l{k}', 'contains'),
            ('node', 'j_d{k}_l{k}_0', 'One {k}', ''),
            ('edge', 'j_d{k}_l{k}', 'j_d{k}_l{k}_0', 'contains'),
            ('node', 'j_d{k}_l{k}_1', 'Two', ''),
            ('edge', 'j_d{k}_l{k}', 'j_d{k}_l{k}_1', 'contains'),
            ('node', 'j_d{k}_l{k}_2', 'Three', ''),
            ('edge', 'j_d{k}_l{k}', 'j_d{k}_l{k}_2', 'contains'),
        ),
    ),
    "terraform": (
        't/m{k}.tf',
        'variable "v{k}" {}\nresource "aws_x" "r{k}" {\n  y = var.v{k}\n}\n',
        (
            ('node', 't_m{k}', 'm{k}.tf', ''),
            ('node', 't_m{k}_var_v{k}', 'var.v{k}', ''),
            ('edge', 't_m{k}', 't_m{k}_var_v{k}', 'contains'),
            ('node', 't_m{k}_aws_x_r{k}', 'aws_x.r{k}', ''),
            ('edge', 't_m{k}', 't_m{k}_aws_x_r{k}', 'contains'),
            ('edge', 't_m{k}_aws_x_r{k}', 't_m{k}_var_v{k}', 'references'),
        ),
    ),
    "ruby": (
        'r/a{k}.rb',
        "require 'set'\nclass A{k} < B\n  def run\n    go(1)\n  end\nend\n",
        (
            ('node', 'r_a{k}', 'a{k}.rb', ''),
            ('node', 'r_a{k}_a{k}', 'A{k}', ''),
            ('edge', 'r_a{k}', 'r_a{k}_a{k}', 'contains'),
            ('call', 'r_a{k}_a{k}', 'B', 'inherits'),
            ('node', 'r_a{k}_a{k}_run', '.run()', ''),
            ('edge', 'r_a{k}_a{k}', 'r_a{k}_a{k}_run', 'method'),
            ('edge', 'r_a{k}', 'set', 'imports_from'),
            ('call', 'r_a{k}_a{k}_run', 'go', 'calls'),
        ),
    ),
    "csharp_project": (
        'c{k}/a.csproj',
        '<Project><ProjectReference Include="..\\b{k}\\b.csproj" /><PackageReference Include="Lib{k}" /></Project>',
        (
            ('node', 'c{k}_a', 'a.csproj', ''),
            ('edge', 'c{k}_a', 'b{k}_b', 'imports_from'),
            ('edge', 'c{k}_a', 'pkg_lib{k}', 'depends_on'),
        ),
    ),
    "tool_config": (
        'm{k}/mcp.json',
        '{"mcpServers": {"s{k}": {"command": "npx", "args": ["-y", "pack{k}"], "env": {"KEY_{k}": "x"}}}}',
        (
            ('node', 'm{k}_mcp', 'mcp.json', ''),
            ('node', 'm{k}_mcp_mcpservers', 'mcpServers', ''),
            ('edge', 'm{k}_mcp', 'm{k}_mcp_mcpservers', 'contains'),
            ('node', 'm{k}_mcp_mcpservers_s{k}', 's{k}', ''),
            ('edge', 'm{k}_mcp_mcpservers', 'm{k}_mcp_mcpservers_s{k}', 'contains'),
            ('edge', 'm{k}_mcp_mcpservers_s{k}', 'pkg_pack{k}', 'references'),
            ('edge', 'm{k}_mcp_mcpservers_s{k}', 'env_key_{k}', 'requires_env'),
        ),
    ),
    "sql_schema": (
        'q/a{k}.sql',
        'CREATE TABLE t{k} (x int REFERENCES u{k}(x));\n',
        (
            ('node', 'q_a{k}', 'a{k}.sql', ''),
            ('node', 'q_a{k}_t{k}', 't{k}', ''),
            ('edge', 'q_a{k}', 'q_a{k}_t{k}', 'contains'),
            ('edge', 'q_a{k}', 'u{k}', 'imports_from'),
        ),
    ),
    "markdown": (
        'd/a{k}.md',
        '# Title {k}\n\nSee [b](b{k}.md).\n',
        (
            ('node', 'd_a{k}', 'a{k}.md', ''),
            ('node', 'd_a{k}_title_{k}', 'Title {k}', ''),
            ('edge', 'd_a{k}', 'd_a{k}_title_{k}', 'contains'),
            ('edge', 'd_a{k}', 'b{k}_md', 'imports_from'),
        ),
    ),
}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _register(name: str, path: str, text: str, rows: tuple[tuple[str, str, str, str], ...]) -> None:
    stated = ", ".join(f"({', '.join(map(_quoted, r))})" for r in rows)
    named = ", ".join(f"replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS {c}" for c in ("a", "b"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("p_partkey").cast("string")
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        files = part.select(*[F.replace(F.lit(t), F.lit("{k}"), key).alias(c) for c, t in (("path", path), ("text", text))])
        found = extract.extract(files)
        other = F.when(F.col("kind") == "edge", F.col("dst")).otherwise(F.col("label"))
        return found.select("kind", F.coalesce("id", "src").alias("a"), other.alias("b"), F.coalesce("relation", F.lit("")).alias("relation"))

    run.__name__, run.__doc__ = f"extract_{name}", f"Files like ``{path}``."
    query(f"SELECT kind, {named}, relation FROM part, (VALUES {stated}) v(kind, a, b, relation)")(run)


for _name, (_path, _text, _rows) in CASES.items():
    _register(_name, _path, _text, _rows)

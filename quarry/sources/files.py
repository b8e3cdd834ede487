"""File scans and language lookup."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text

SKIPPED = (".git", "node_modules", "vendor")

#: Extensions of each language, from what their communities use; of several languages of one extension the alphabetically first counts.
_TABLE = """
abap: abap | ada: adb ada ads | agda: agda | apex: cls apex | applescript: applescript scpt | arduino: ino | asciidoc: adoc asciidoc asc | assembly: asm s nasm | astro: astro | autohotkey: ahk | awk: awk gawk
ballerina: bal | batchfile: bat cmd | bazel: bzl bazel | bicep: bicep | bibtex: bib | c: c h cats idc | c#: cs csx cake | c++: cc cpp cxx c++ hpp hh hxx h++ ipp tpp inl ixx | cairo: cairo | cap'n proto: capnp | clojure: clj cljs cljc edn boot
cmake: cmake | cobol: cob cbl cobol cpy | coffeescript: coffee cson iced | common lisp: lisp lsp asd cl | coq: v coq | crystal: cr | css: css | csv: csv | cuda: cu cuh | cue: cue | cython: pyx pxd pxi | d: d di | dart: dart | dhall: dhall
diff: diff patch | dockerfile: dockerfile containerfile | dot: dot gv | eiffel: e | elixir: ex exs | elm: elm | emacs lisp: el emacs | erb: erb | erlang: erl hrl escript xrl yrl | f#: fs fsi fsx | factor: factor | fish: fish | forth: fth 4th forth | fortran: f90 f95 f03 f08 f for f77
gdscript: gd | gherkin: feature | gleam: gleam | glsl: glsl vert frag geom tesc comp | gnuplot: gp gnuplot plt | go: go | go template: gotmpl tmpl | gradle: gradle | graphql: graphql gql graphqls | groovy: groovy grt gvy gsh | hack: hack hhi | haml: haml | handlebars: handlebars hbs | haskell: hs hsc lhs | haxe: hx hxsl | hcl: hcl nomad tf tfvars | hlsl: hlsl fx fxh
html: html htm xhtml xht | idl: pro | idris: idr | ini: ini cfg prefs properties lektorproject | j: ijs | janet: janet | java: java jav jsh | java server pages: jsp | javascript: js jsx mjs cjs es6 jsm ssjs | jinja: jinja j2 jinja2 | json: json geojson jsonl webmanifest har avsc ndjson | json5: json5 jsonc | jsonnet: jsonnet libsonnet | julia: jl | jupyter notebook: ipynb
kotlin: kt kts ktm | latex: tex sty ltx bbx cbx | less: less | liquid: liquid | llvm: ll | logos: xm xi | lua: lua rbxs wlua nse | makefile: mk mak make | markdown: md markdown mdown mkd mkdn livemd | mathematica: nb wl wls | matlab: m matlab | mdx: mdx | mercury: moo | meson: meson | metal: metal | mojo: mojo | mustache: mustache | nim: nim nimble nims
nix: nix | nunjucks: njk | objective-c++: mm | ocaml: ml mli mll mly eliom | odin: odin | opencl: opencl | openscad: scad | org: org | pascal: pas dpr lpr pp | perl: pl pm perl ph plx t psgi | php: php phtml php3 php4 php5 phps | plsql: pls plb pck pkb pks | postscript: ps eps | pov-ray sdl: pov | powershell: ps1 psm1 psd1 | prisma: prisma | processing: pde | prolog: prolog yap
protocol buffer: proto textproto pbtxt | pug: pug jade | puppet: epp | purescript: purs | python: py pyi pyw py3 gyp wsgi | qml: qml | r: r rd rsx | racket: rkt rktd rktl scrbl | raku: raku rakumod p6 pm6 | reason: re rei | rescript: res resi | restructuredtext: rst rest | rexx: rexx | robot framework: robot | roff: man roff 1 | ruby: rb rake gemspec podspec rbw ru thor jbuilder
rust: rs | sas: sas | sass: sass | scala: scala sc sbt | scheme: scm ss sld sps | scss: scss | shell: sh bash zsh ksh bats command tool | smalltalk: st | smithy: smithy | solidity: sol | sparql: sparql rq | sql: sql ddl mysql prc tab udf viw | standard ml: sml sig fun | starlark: star | stylus: styl | svelte: svelte | svg: svg | swift: swift | systemverilog: sv svh vh
tcl: tcl tm | terra: t | text: txt fr | thrift: thrift | toml: toml | tsv: tsv | turtle: ttl | twig: twig | typescript: ts tsx mts cts | v: vv vsh | vala: vala vapi | velocity: vm vtl | verilog: veo | vhdl: vhdl vhd | vim script: vim vmb | visual basic: vb bas frm vba | vue: vue | webassembly: wat wast | webidl: webidl | wgsl: wgsl | x10: x10 | xml: xml xsd xsl xslt wsdl plist rss csproj vcxproj | xquery: xq xquery xqm | yacc: y yy | yaml: yml yaml sublime-syntax | zig: zig zon
"""
LANGUAGES = {n.strip(): e.split() for n, e in (x.split(": ") for line in _TABLE.strip().splitlines() for x in line.split(" | "))}
_SHORT = "golang=go py=python python3=python rusty=rust rs=rust ts=typescript tsx=typescript js=javascript jsx=javascript node=javascript ecmascript=javascript cpp=c++ cplusplus=c++ cxx=c++ csharp=c# dotnet=c# fsharp=f# rb=ruby jruby=ruby sh=shell bash=shell zsh=shell shell-script=shell yml=yaml kt=kotlin md=markdown pandoc=markdown objc=objective-c perl6=raku pl=perl ps1=powershell posh=powershell pwsh=powershell vb=visual basic hs=haskell ml=ocaml ex=elixir erl=erlang clj=clojure jl=julia tex=latex make=makefile mk=makefile docker=dockerfile tf=hcl terraform=hcl proto=protocol buffer protobuf=protocol buffer gql=graphql viml=vim script vim=vim script elisp=emacs lisp emacs=emacs lisp lisp=common lisp delphi=pascal objectpascal=pascal sol=solidity nixos=nix htm=html xhtml=html batch=batchfile bat=batchfile dosbatch=batchfile rst=restructuredtext ipynb=jupyter notebook sv=systemverilog"
ALIASES = {}
for _word in _SHORT.split(" "):  # names may hold blanks
    if "=" in _word:
        _key, _name = _word.split("=")
        ALIASES[_key] = _name
    else:
        ALIASES[_key] += f" {_word}"


def parse_languages(names: str | Sequence[str]) -> list[str]:
    """The languages of a list, or of names with commas between them, by their usual names and without repeats."""
    parts = names.split(",") if isinstance(names, str) else names
    return list(dict.fromkeys(n for n in map(normalize, parts) if n))


def scan(spark: SparkSession, path: str, languages: str | Sequence[str] = (), skip: Sequence[str] = SKIPPED, binaries: bool = False, output: str = "", links: bool = False) -> DataFrame:
    """(path, content, size, modified, language) of every file under ``path``, content as text.

    ``output`` is a folder within it that is left out, as what a job writes
    isn't its source. Symbolic links of a local folder are left out unless
    ``links``. Rows come in no order; sort by path where one is needed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    for name in skip:
        raw = raw.where(~F.col("path").contains(f"/{name}/"))
    if output:
        raw = raw.where(~F.col("path").contains(f"/{output.strip('/')}/"))
    if not links:
        raw = _without_links(raw)
    if not binaries:
        raw = raw.where(~text.is_binary(F.col("content")))
    out = detect_language(raw.select("path", F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    wanted = parse_languages(languages)
    return out.where(F.col("language").isin(wanted)) if wanted else out


def _without_links(raw: DataFrame) -> DataFrame:
    @F.pandas_udf("boolean")
    def linked(s: pd.Series) -> pd.Series:
        return s.map(lambda p: p.startswith("file:") and os.path.islink(unquote(p.removeprefix("file:"))))

    return raw.where(~linked("path"))


def detect_language(files: DataFrame, path_col: str = "path", table: DataFrame | None = None) -> DataFrame:
    """``files`` with the language of the extension, empty when unknown; of several names the first counts."""
    spark = files.sparkSession
    if table is None:
        table = spark.createDataFrame([(f".{e}", n) for n, ext in LANGUAGES.items() for e in ext], "extension string, name string")
    known = table.groupBy(F.lower("extension").alias("__e")).agg(F.min(F.lower("name")).alias("__n"))
    ext = text.extension(text.strip_branch(F.col(path_col)))
    return files.join(F.broadcast(known), ext == F.col("__e"), "left").select(*files.columns, F.coalesce("__n", F.lit("")).alias("language"))  # a row for each extension there is


def normalize(name: str) -> str:
    n = name.strip().lower().lstrip(".")
    return ALIASES.get(n, n)


def language_name(name: Column) -> Column:
    """The usual name of a language for an alias of it."""
    n = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[n], n)

"""A catalogue of declared relations: columns with meanings, layers, and the declarations that programs include."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rulewright.errors import ProgramError

#: What a column means, over the two types of facts.
MEANINGS = {"symbol": "symbol", "number": "number", "instr_id": "symbol", "func_id": "symbol", "label": "symbol"}
LAYERS = ["bytecode", "extractor", "priors", "project", "staged"]


@dataclass(frozen=True)
class RelationSpec:
    """A relation's name, columns with their meanings, and layer. In-process relations never become program inputs."""

    name: str
    columns: tuple[tuple[str, str], ...]
    layer: str = "extractor"
    doc: str = ""
    in_process: bool = False

    def decl(self) -> str:
        columns = ", ".join(f"{c}: {MEANINGS[m]}" for c, m in self.columns)
        return f".decl {self.name}({columns}) mutable\n.input {self.name}"

    def schema(self) -> StructType:
        """Spark's schema; a column's meaning is in its metadata."""
        kinds = {"symbol": StringType(), "number": IntegerType()}
        return StructType([StructField(c, kinds[MEANINGS[m]], False, {"kind": m}) for c, m in self.columns])


class Catalogue:
    def __init__(self, specs: Iterable[RelationSpec]):
        self.specs: dict[str, RelationSpec] = {}
        for s in specs:
            self.add(s)

    def add(self, s: RelationSpec) -> None:
        if s.name in self.specs:
            raise ProgramError(f"{s.name} is declared twice; names aren't overloaded by width")
        if s.layer not in LAYERS:
            raise ProgramError(f"{s.name}: no layer is named {s.layer}")
        for c, m in s.columns:
            if m not in MEANINGS:
                raise ProgramError(f"{s.name}.{c}: no meaning is named {m}")
        self.specs[s.name] = s

    def declarations(self, names: Iterable[str] | None = None, layer: str | None = None) -> str:
        """Declarations by name, of the named relations or of all (of a layer); without those that stay in process."""
        wanted = [self[n] for n in names] if names is not None else self.specs.values()
        kept = [s for s in wanted if not s.in_process and layer in (None, s.layer)]
        return "\n".join(s.decl() for s in sorted(kept, key=lambda s: s.name)) + "\n"

    def __getitem__(self, name: str) -> RelationSpec:
        if name not in self.specs:
            raise ProgramError(f"the catalogue has no {name}")
        return self.specs[name]

    def frame(self, spark: SparkSession, name: str, rows: Iterable[tuple]) -> DataFrame:
        """Rows that stand in a test or a caller's code as the relation's table."""
        return spark.createDataFrame(list(rows), self[name].schema())

    def with_meanings(self, name: str, df: DataFrame) -> DataFrame:
        """df, which has the relation's columns in order, with its names, types and meanings."""
        fields = self[name].schema().fields
        if len(fields) != len(df.columns):
            raise ProgramError(f"{name} has {len(fields)} columns, not {len(df.columns)}")
        return df.select(*(df[c].cast(f.dataType).alias(f.name, metadata=f.metadata) for c, f in zip(df.columns, fields, strict=True)))


def _spec(layer: str, line: str) -> RelationSpec:
    name, _, columns = line.partition("(")
    return RelationSpec(name.strip(), tuple(tuple(x.strip().split(": ")) for x in columns.rstrip(") ").split(",")), layer)


# The names, columns and meanings of the facts that the programs of this package read.
_FACTS = {
    "bytecode": """
bif_call(id: instr_id, caller: func_id, mod: symbol, func: symbol, arity: number, fail: number)
closure_def(parent_func: func_id, closure_func: func_id)
conditional_call(id: instr_id)
def_use(def_id: instr_id, use_id: instr_id)
fun_ref(caller: func_id, callee: func_id)
function_def(func: func_id, mod: symbol, name: symbol, arity: number, exported: number)
literal_value(id: instr_id, reg: symbol, val: symbol)
local_call(id: instr_id, caller: func_id, target: func_id, arity: number)
remote_call(id: instr_id, caller: func_id, mod: symbol, func: symbol, arity: number)
resolved_apply(id: instr_id, caller: func_id, target: func_id)
tuple_literal(id: instr_id, reg: symbol, tag: symbol, size: number)
""",
    "extractor": """
impure_call(id: instr_id, caller: func_id, api: symbol, category: symbol, mode: symbol)
added_child(supervisor: symbol, child_mod: symbol, restart: symbol, type: symbol, caller_func: func_id)
async_cast(caller_func: func_id, callee_mod: symbol)
call_arg(caller: func_id, callee: func_id, arg_pos: number, value: symbol)
call_arg_derived(caller: func_id, callee: func_id, arg_pos: number, param_pos: number)
call_arg_var(id: instr_id, caller: func_id, callee: func_id, arg_pos: symbol, via: symbol, var_kind: symbol, var: symbol)
call_result_var(id: instr_id, func: func_id, callee: func_id)
child_spec_option(mod: symbol, field: symbol, key: symbol, default: symbol)
child_spec_restart(mod: symbol, restart: symbol)
child_spec_type(mod: symbol, type: symbol)
dynamic_child(supervisor: symbol, child_mod: symbol, caller_func: func_id)
dynamic_child_restart(supervisor: symbol, child_mod: symbol, caller_func: func_id, restart: symbol)
ets_new(id: instr_id, func: func_id, name: symbol)
ets_operation(id: instr_id, func: func_id, table_ref: symbol, operation: symbol, kind: symbol)
field_load(func: func_id, load: symbol, field: symbol, var_kind: symbol, var: symbol)
field_store(func: func_id, term: symbol, field: symbol, var_kind: symbol, var: symbol)
fun_handed(id: instr_id, caller: func_id, fun: func_id, arg_pos: symbol)
global_register(id: instr_id, func: func_id, name: symbol, arity: symbol)
implements_behaviour(mod: symbol, behaviour: symbol)
imprecision(category: symbol, func: func_id, relation: symbol, reason: symbol)
inspect_derived(mod: symbol)
inspect_shows(mod: symbol, field: symbol)
lineless_schema(mod: symbol)
named_process(mod: symbol, name: symbol)
process_call_var(id: instr_id, func: func_id, api_kind: symbol, var_kind: symbol, var: symbol)
process_register(id: instr_id, func: func_id, name: symbol, method: symbol)
process_register_var(id: instr_id, func: func_id, name: symbol, var_kind: symbol, var: symbol)
process_start(id: instr_id, func: func_id, process: symbol, kind: symbol, runs: symbol)
redacted_field(mod: symbol, field: symbol)
return_var(func: func_id, var_kind: symbol, var: symbol)
schema_field(mod: symbol, field: symbol, type: symbol)
shorthand_arg(supervisor: symbol, child_mod: symbol, at: symbol, shape: symbol)
shorthand_option(supervisor: symbol, child_mod: symbol, at: symbol, key: symbol, value: symbol)
supervisor(mod: symbol, strategy: symbol)
supervisor_child(supervisor: symbol, position: number, child_mod: symbol, restart: symbol, type: symbol)
supervisor_child_form(supervisor: symbol, position: number, form: symbol)
sync_call(caller_func: func_id, callee_mod: symbol)
table_allocation(id: instr_id, func: func_id, table: symbol)
table_use(id: instr_id, func: func_id, var_kind: symbol, var: symbol)
term_allocation(func: func_id, term: symbol, shape: symbol, tag: symbol, arity: symbol)
tls_connect(id: instr_id, func: func_id, api: symbol, options: symbol)
tls_server_side(id: instr_id, func: func_id)
tls_verification(id: instr_id, func: func_id, setting: symbol)
""",
    "priors": """
prior_sensitive(subject_kind: symbol, mod: symbol, name: symbol, kind: symbol, detail: symbol, detail_permille: number, permille: number)
""",
    "staged": """
awaits_task(func: func_id, start: instr_id, runs: func_id)
call_edge(caller: func_id, callee: func_id)
named_pid(name: symbol, process: symbol)
process_call(func: func_id, anchor: instr_id, site: instr_id, api_kind: symbol, process: symbol)
server_process(process: symbol, mod: symbol)
""",
}
FACTS = Catalogue(_spec(layer, line) for layer, lines in _FACTS.items() for line in lines.split("\n") if line)

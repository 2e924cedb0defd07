"""Named steps whose DataFrames are handed on by name, and the command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.params import Context, evaluate, register_step
from ..functions.transforms import Options
from ..operators.compiler import apply_spec
from ..sources.readers import dispatch, find_config, open_client, read_config
from ..sources.sinks import export_csv


class StepExists(ValueError):
    pass


class ArgumentExists(ValueError):
    pass


@dataclass
class Step:
    """A callable, its arguments, and where its result goes: {step: {'as_arg': name}}."""

    name: str
    run: Callable
    arguments: dict[str, Any] = field(default_factory=dict)
    forward_to: dict[str, dict] = field(default_factory=dict)

    def add_argument(self, name: str, value: Any) -> None:
        if name in self.arguments:
            raise ArgumentExists(f"{self.name} has an argument {name!r} already")
        self.arguments[name] = value


class Pipeline:
    """Steps in insertion order. Only plans pass between them; the sink's action runs the job."""

    def __init__(self):
        self.steps: dict[str, Step] = {}

    def add(self, step: Step) -> Pipeline:
        if step.name in self.steps:
            raise StepExists(step.name)
        self.steps[step.name] = step
        return self

    def run(self) -> dict[str, Any]:
        """Results by step. One that goes to several steps is persisted while they run."""
        results, held = {}, []
        for step in self.steps.values():
            value = results[step.name] = step.run(**step.arguments)
            if isinstance(value, DataFrame) and len(step.forward_to) > 1:
                value = results[step.name] = value.persist()
                held.append(value)
            for name, how in step.forward_to.items():
                self.steps[name].add_argument(how["as_arg"], value)
        for df in held:
            df.unpersist()
        return results


def build(config: dict, inputs: dict | None = None) -> Pipeline:
    """A pipeline from a ``list`` of ``pipeline`` nodes (or {'items': [...]})."""
    out, ctx = Pipeline(), Context(inputs)
    for node in config["items"] if isinstance(config, dict) else config:
        d = ctx.value(node)
        out.add(Step(d["name"], d["client"], dict(evaluate(d["arguments"], inputs) or {}), dict(d["forward_to"])))
    return out


@register_step("load_config")
def load_config(config_root: str, module: str, namespace: str, config_name: str) -> dict:
    return read_config(find_config(config_root, module, namespace, config_name))


@register_step("connect")
def open_source(config: dict, spark: SparkSession | None = None, external_input: dict | None = None, config_root: str | None = None):
    """The source a connector configuration names under ``client``, authorised where it asks for that."""
    return open_client(spark or SparkSession.active(), config, external_input, config_root)


@register_step("dispatch")
def receive(client, config: dict, external_input: dict | None = None) -> DataFrame:
    return dispatch(client, config["request"], external_input)


@register_step("serialize")
def serialize(records: DataFrame, config: dict, normalize_compat: bool = False, intended: bool = False, keep: tuple = ()) -> DataFrame:
    return apply_spec(records, config, Options(intended=intended), normalize_compat, tuple(keep))


@register_step("export")
def export(records: DataFrame, config: dict, output_dir: str, order_by: list[str] | None = None) -> str:
    return export_csv(records, config["export"], output_dir, order_by)


def pair(text: str) -> tuple[str, str]:
    key, mark, value = text.partition("=")
    if not mark:
        raise argparse.ArgumentTypeError(f"{text!r} is not key=value")
    return key, value


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    p = argparse.ArgumentParser(description="Run a configured record pipeline on Spark.")
    p.add_argument("--namespace", required=True)
    p.add_argument("--pipeline-config", required=True)
    p.add_argument("--data-ingestion-config", required=True)
    p.add_argument("--config-root", required=True)
    p.add_argument("--output-dir", help="a folder that driver and executors share; by default exports in the warehouse")
    p.add_argument("--auth-data", type=pair, action="extend", nargs="+", default=[])
    p.add_argument("--external-input", type=pair, action="extend", nargs="+", default=[])
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    data = dict(a.external_input)  # credentials stay in a store of their own and in no plan
    inputs = {"namespace": a.namespace, "data_ingestion_config": a.data_ingestion_config, "config_root": a.config_root, "output_dir": a.output_dir or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/exports", "auth_store": dict(a.auth_data), "data_store": data, "spark": spark, **data}
    built = build(read_config(a.pipeline_config), inputs)
    if a.verbose:
        print("steps:", *built.steps)
    return built.run()


if __name__ == "__main__":
    main()

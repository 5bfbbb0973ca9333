"""The operations this engine answers, and what of each is built.

Each name maps to the functions that answer it. An empty tuple marks an
operation that is not built yet.
"""

from __future__ import annotations

_S, _T, _C, _G, _H, _R, _P, _X, _E = (
    f"octetloom.operators.{m}" for m in ("scans", "tables", "compare", "graph", "hardware", "raster", "project", "exports", "sandbox")
)
_F = "octetloom.sources"
_PLAN = "octetloom.plans.write_plan.commit"

OPERATIONS: dict[str, tuple[str, ...]] = {
    "source.survey": (f"{_S}.survey",),
    "source.read": (f"{_X}.read_window",),
    "source.carve": (f"{_X}.carve", _PLAN),
    "container.adf.list": (f"{_F}.volumes.listing",),
    "container.adf.extract": (f"{_F}.volumes.contents", _PLAN),
    "container.lha.list": (f"{_F}.archives.listing",),
    "container.lha.extract": (f"{_F}.archives.contents", _PLAN),
    "analysis.table.decode": ("octetloom.operators.layout.decode",),
    "analysis.table.summarize": (f"{_T}.summarize", f"{_T}.compare"),
    "analysis.state.snapshot": ("octetloom.operators.state.snapshot",),
    "analysis.state.compare": (f"{_C}.state_differences",),
    "analysis.strings.scan": (f"{_S}.strings_scan",),
    "analysis.pointers.scan": (f"{_S}.pointer_runs",),
    "audio.pcm.scan": (f"{_S}.pcm_regions",),
    "audio.module.scan": (f"{_F}.media.modules",),
    "graphics.palette.scan": (f"{_S}.palette_tables", f"{_S}.palette_runs"),
    "hardware.copper.scan": (f"{_S}.copper_lists",),
    "graphics.bitmap.detect": (f"{_S}.entropy_map", f"{_S}.autocorrelation", f"{_S}.geometry_candidates"),
    "analysis.hunk.list": (f"{_F}.executables.segments", f"{_F}.executables.relocations"),
    "analysis.hunk.diff": (f"{_C}.presence", f"{_C}.changed_ranges", f"{_C}.only_in"),
    "analysis.hunk.diff.export": (f"{_X}.json_file", _PLAN),
    "analysis.hunk.normalize": (),
    "analysis.hunk.normalize.export": (),
    "provenance.manifest": (f"{_P}.manifest",),
    "provenance.manifest.export": (f"{_X}.manifest_file", _PLAN),
    "analysis.address.resolve": (f"{_H}.resolve_address",),
    "analysis.code.disassemble": (),
    "analysis.address.references": (f"{_G}.references_to", f"{_G}.reverse_references"),
    "analysis.code.callgraph": (f"{_G}.call_edges", f"{_G}.call_nodes"),
    "analysis.code.globals": (),
    "analysis.code.fixed-point": (f"{_R}.follows",),
    "analysis.code.facts": (f"{_G}.select_facts", f"{_G}.function_summaries"),
    "hardware.register.list": (f"{_H}.register_map",),
    "hardware.register.references": (f"{_H}.register_references",),
    "hardware.copper.decode": (f"{_H}.decode_copper", f"{_H}.display_spec"),
    "hardware.copper.references": (),
    "graphics.bitmap.decode": (f"{_R}.decode_planar", f"{_R}.planar_to_chunky"),
    "graphics.bitmap.export": (f"{_X}.png_files", _PLAN),
    "graphics.bitmap.compare": (f"{_R}.pixel_differences", f"{_R}.substitutions", f"{_R}.bounds", f"{_R}.connected_regions"),
    "graphics.bitmap.compare.export": (f"{_X}.heatmap_files", _PLAN),
    "graphics.palette.decode": ("octetloom.functions.bytes.rgb4_to_rgb8",),
    "graphics.palette.export": (f"{_X}.swatch_files", _PLAN),
    "graphics.ilbm.decode": (f"{_F}.media.pictures",),
    "audio.sample.decode": (f"{_F}.media.samples", f"{_S}.envelope"),
    "audio.sample.export": (f"{_X}.wav_files", _PLAN),
    "audio.pcm.decode": (f"{_S}.envelope",),
    "audio.pcm.export": (f"{_X}.wav_files", _PLAN),
    "audio.module.decode": (f"{_F}.media.read_module",),
    "audio.module.export": (f"{_X}.carve", _PLAN),
    "compress.powerpacker.decode": (f"{_F}.codecs.power_packed",),
    "compress.powerpacker.export": (f"{_F}.codecs.power_packed", _PLAN),
    "compress.rle-xor.decode": (f"{_F}.codecs.rle_xor",),
    "compress.rle-xor.export": (f"{_F}.codecs.rle_xor", _PLAN),
    "env.sandbox.run": (),
    "env.sandbox.call": (),
    "env.sandbox.call.export": (),
    "env.sandbox.matrix": (f"{_E}.within_budget",),
    "env.sandbox.matrix.export": (),
    "env.sandbox.timeline": (f"{_E}.timeline",),
    "env.sandbox.timeline.export": (),
    "env.sandbox.compare": (f"{_C}.record_differences", f"{_C}.first_divergence", f"{_C}.occurrences"),
    "env.sandbox.slice": (f"{_G}.backward_slice",),
    "env.boot.info": (f"{_F}.volumes.boots",),
    "env.boot.trace": (),
    "env.boot.trace.export": (),
    "env.frame.capture": (),
    "env.frame.capture.export": (),
    "project.check": (f"{_P}.dangling", f"{_P}.duplicates"),
    "project.verify": (f"{_P}.manifest",),
    "project.describe": ("octetloom.plans.queries.project_describe",),
    "project.annotations": (f"{_G}.covering",),
    "project.inventory": (f"{_F}.table.read_files", f"{_P}.tree_hash"),
    "project.edit": (),
    "project.format": (),
    "project.migrate": (),
    "project.init": (),
    "project.extract": (),
    "project.resource.export": (),
}


def missing() -> list[str]:
    return [name for name, answered in OPERATIONS.items() if not answered]

"""Prompts for the models that extract, compare, summarise and judge: plain texts from rows."""

from __future__ import annotations

import json

_JSON = "Answer with JSON only, without comments."


def as_text(value) -> str:
    """A value as it goes into a prompt: texts as they are, nothing for null, the rest as JSON."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _listed(rows: list[dict], *fields: str) -> str:
    return "\n".join(json.dumps({f: r.get(f) for f in fields}, ensure_ascii=False) for r in rows)


def extraction(messages: list[dict], background: list[dict] = (), scene: str = "", zone: str = "") -> str:
    """Facts worth keeping of new messages; background is for understanding only."""
    parts = [
        "Find what is worth remembering in a conversation: lasting traits and tastes (persona), events with their times (episodic), and standing wishes about how to be served (instruction).",
        "Group facts by scene. " + (f"The last scene was: {scene}." if scene else ""), zone,
        "Earlier messages, for understanding only:\n" + _listed(background, "role", "content", "timestamp") if background else "",
        "New messages:\n" + _listed(messages, "id", "role", "content", "timestamp"),
        'Form: [{"scene_name": "", "memories": [{"content": "", "type": "persona|episodic|instruction", "priority": 0-100, "source_message_ids": [], "metadata": {}}]}]. ' + _JSON,
    ]
    return "\n\n".join(p.strip() for p in parts if p.strip())


def comparison(new: list[dict], known: dict[str, list[dict]]) -> str:
    """What to do with new facts, given known ones that are close to each."""
    rows = [f"New {json.dumps({k: m.get(k) for k in ('record_id', 'content', 'type')}, ensure_ascii=False)}\nKnown:\n{_listed(known.get(m['record_id'], []), 'record_id', 'content', 'type') or '(none)'}" for m in new]
    form = 'Form: [{"record_id": "", "action": "store|skip|update|merge", "target_ids": [], "merged_content": "", "merged_type": "", "merged_priority": 0}]. ' + _JSON
    return "\n\n".join(["Decide for each new fact: store it, skip it as known, update a known one, or merge it with known ones.", *rows, form])


def scenes(memories: list[dict], found: list[dict], advice: str = "") -> str:
    """Facts to work into scene files, of which there are some."""
    return "\n\n".join(p for p in ["Work these facts into the scene files with the tools at hand; end with [PERSONA_UPDATE: reason] if the picture of the person changed.", "Facts:\n" + _listed(memories, "content", "type", "scene_name"), "Scenes:\n" + _listed(found, "filename", "summary", "heat"), advice] if p)


def persona(old: str, changed: list[dict], reason: str = "") -> str:
    mode = "Revise this portrait:\n" + old if old.strip() else "Write a portrait of the person."
    return "\n\n".join(p for p in [mode, f"Reason: {reason}" if reason else "", "Scenes that changed:\n" + "\n---\n".join(f"{s.get('filename', '')}\n{s.get('body', '')}" for s in changed)] if p)


def summaries(pairs: list[dict], recent: str = "", most: int = 2000) -> str:
    """Tool calls to summarise; long parameters and results are cut."""
    cut = lambda x: x if len(x) <= most else x[:most] + "..."
    rows = [f"tool_call_id: {p['tool_call_id']}\ntool: {p['tool_name']}\nparams: {cut(as_text(p.get('params')))}\nresult: {cut(as_text(p.get('result')))}" for p in pairs]
    form = 'Form: [{"tool_call_id": "", "tool_call": "", "summary": "", "score": 0-10}], one for each call; the score says how safely the result can be replaced. ' + _JSON
    return "\n\n".join(p for p in ["Summarise each tool call.", "Context:\n" + recent if recent else "", *rows, form] if p)


def judgement(recent: str, current: str = "", diagrams: list[dict] = ()) -> str:
    form = 'Form: {"taskCompleted": false, "isContinuation": false, "isLongTask": false, "continuationMmdFile": null, "newTaskLabel": null}. ' + _JSON
    return "\n\n".join(p for p in ["Judge where tasks begin and end in these messages.", recent, "Current diagram:\n" + current if current else "", "Diagrams:\n" + _listed(diagrams, "filename", "goal") if diagrams else "", form] if p)


def diagram(entries: list[dict], current: str = "", label: str = "") -> str:
    numbered = "\n".join(f"{k}: {x}" for k, x in enumerate(current.splitlines(), 1))
    form = 'Form: {"file_action": "write|replace", "mmd_content": "", "replace_blocks": [{"start_line": 1, "end_line": 1, "content": ""}], "node_mapping": {"tool_call_id": "node"}}. ' + _JSON
    return "\n\n".join(p for p in [f"Keep the flowchart of the task{' ' + label if label else ''} up to date.", "Present lines:\n" + numbered if numbered else "", "Entries:\n" + _listed(entries, "tool_call_id", "tool_call", "summary", "timestamp"), form] if p)

"""Multi-turn sessions to training samples: routing tree, token drift, linearisation.

A session's turns go to one task in order (sessions are bounded by their turns). Every turn's prompt is
matched against the tree of messages seen; what does not match branches off. Each leaf's chain of
generated turns is laid into token sequences; a turn shared by several leaves is trained once.

Rules of drift, where a turn's prompt is held against the tokens laid so far: equal prefix, the rest is
appended (clean); a difference within the last response and a short new response, that span is
overwritten untrained (realign); anything else starts a new sequence (fork).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.operators.grouped import map_groups


@dataclass
class Turn:
    prompt_ids: list[int]
    output_ids: list[int]
    finish_reason: str | None = None
    log_probs: list[float] = field(default_factory=list)
    ill_formed: bool = False


@dataclass
class Node:
    message: object = None
    role: str | None = None
    turn: Turn | None = None
    number: int = 0
    children: list[Node] = field(default_factory=list)
    claimed: bool = False


def grow(root: Node, turns: list[tuple[list[dict], Turn, dict | None]], threshold: int) -> Node:
    """Mount (prompt messages, turn, response message) triples; a short single rewritten reply is replaced in place."""
    for number, (messages, turn, reply) in enumerate(turns, 1):
        if not messages:
            continue
        node, depth = root, 0
        while depth < len(messages):
            match = next((c for c in node.children if c.role == messages[depth].get("role") and c.message == messages[depth]), None)
            if match is None:
                break
            node, depth = match, depth + 1
        if threshold > 0 and depth < len(messages) and messages[depth].get("role") == "assistant":
            replies = [c for c in node.children if c.role == "assistant"]
            if len(replies) == 1 and not replies[0].children and replies[0].turn is not None and len(replies[0].turn.output_ids) < threshold:
                replies[0].turn, replies[0].number, replies[0].message = None, 0, messages[depth]
                node, depth = replies[0], depth + 1
        for m in messages[depth:]:
            child = Node(m, m.get("role"))
            node.children.append(child)
            node = child
        node.children.append(Node(reply, "assistant", turn, number))
    return root


def chains(node: Node, above: tuple[Node, ...] = ()) -> list[tuple[Node, ...]]:
    """Paths from below the root to each leaf, depth first."""
    out, stack = [], [(c, above) for c in reversed(node.children)]
    while stack:
        at, path = stack.pop()
        path = (*path, at)
        if at.children:
            stack += [(c, path) for c in reversed(at.children)]
        else:
            out.append(path)
    return out


@dataclass
class Sequence:
    tokens: list[int] = field(default_factory=list)
    mask: list[int] = field(default_factory=list)
    log_probs: list[float] = field(default_factory=list)
    last_response: int | None = None
    lead: int = 0

    def drift(self, turn: Turn, threshold: int) -> str:
        same = 0
        for a, b in zip(self.tokens, turn.prompt_ids):
            if a != b:
                break
            same += 1
        if same == len(self.tokens):
            return "clean"
        near = self.last_response is not None and same >= self.last_response
        return "realign" if near and len(turn.output_ids) < threshold else "fork"

    def lay(self, turn: Turn, kind: str, trained: bool) -> None:
        if self.last_response is None:
            self.lead = len(turn.prompt_ids)
        keep = self.last_response if kind == "realign" else len(self.tokens)
        del self.tokens[keep:], self.mask[keep:], self.log_probs[keep:]
        self._add(turn.prompt_ids[keep:], 0, None)
        self.last_response = len(self.tokens)
        self._add(turn.output_ids, int(trained), turn.log_probs if trained else None)

    def _add(self, ids: list[int], mask: int, log_probs: list[float] | None) -> None:
        self.tokens += ids
        self.mask += [mask] * len(ids)
        self.log_probs += log_probs or [0.0] * len(ids)


def linearised(root: Node, threshold: int, most_tokens: int = 0) -> list[dict]:
    """Samples of all leaves: tokens, mask and log-probabilities of the response region, and flags."""
    out = []
    for chain in chains(root):
        made = [n for n in chain if n.role == "assistant" and n.turn is not None]
        parts: list[Sequence] = []
        for n in made:
            trained, n.claimed = not n.claimed, True
            kind = parts[-1].drift(n.turn, threshold) if parts else "fork"
            if kind == "fork":
                parts.append(Sequence())
                kind = "clean"
            parts[-1].lay(n.turn, kind, trained)
        flags = {"truncated": bool(made) and made[-1].turn.finish_reason == "length", "ill_formed": any(n.turn.ill_formed for n in made), "turns": len(made)}
        for p in parts:
            if any(p.mask[p.lead :]):
                end = most_tokens or None
                out.append({"tokens": p.tokens[:end], "loss_mask": p.mask[p.lead : end], "log_probs": p.log_probs[p.lead : end], "response_length": len(p.mask[:end]) - p.lead, **flags})
    return out


SAMPLE = "session_id string, sample int, tokens array<int>, loss_mask array<int>, log_probs array<double>, response_length int, truncated boolean, ill_formed boolean, turns int"


def session_samples(turns: DataFrame, threshold: int = 16, most_tokens: int = 0) -> DataFrame:
    """Samples of every session. ``turns`` has (session_id, turn, prompt_ids, output_ids, output_log_probs,
    finish_reason, ill_formed); a turn delivered again counts once; null ids are empty."""

    def run(key: tuple, part: list[dict]) -> list[tuple]:
        records, said, seen = [], [], None
        for r in part:
            if r["turn"] == seen:
                continue
            seen = r["turn"]
            turn = Turn(r["prompt_ids"] or [], r["output_ids"] or [], r["finish_reason"], r["output_log_probs"] or [], bool(r["ill_formed"]))
            prompt = [*said, {"role": "user", "content": tuple(turn.prompt_ids)}]
            reply = {"role": "assistant", "content": tuple(turn.output_ids)}
            records.append((prompt, turn, reply))
            said = [*prompt, reply]
        rows = linearised(grow(Node(), records, threshold), threshold, most_tokens)
        return [(key[0], i, s["tokens"], s["loss_mask"], s["log_probs"], s["response_length"], s["truncated"], s["ill_formed"], s["turns"]) for i, s in enumerate(rows)]

    columns = ["session_id", "turn", "prompt_ids", "output_ids", "output_log_probs", "finish_reason", "ill_formed"]
    kept = turns.where("session_id is not null and turn is not null").select(*columns)
    return map_groups(kept, ["session_id"], ["turn"], run, SAMPLE)

"""Grid mazes: generation, parsing, shortest path, and validation of an action sequence."""

from __future__ import annotations

import random
from collections import deque

# The vocabulary of maze sequences.
MOVES = {"UP": (-1, 0), "DOWN": (1, 0), "LEFT": (0, -1), "RIGHT": (0, 1)}
CELLS = {"WALL", "PATH", "START", "GOAL"}
TRAILING = {"<eos>", "<pad>"}

Grid = list[list[str]]


def generate(size: int, seed: int, method: str = "dfs") -> Grid:
    """A perfect maze on an odd square grid; START and GOAL are distinct cells. Each seed gives one maze."""
    if size < 5 or size % 2 == 0:
        raise ValueError("size must be odd and at least 5")
    rng = random.Random(seed)
    grid = [["WALL"] * size for _ in range(size)]
    cells = [(r, c) for r in range(1, size, 2) for c in range(1, size, 2)]
    first = rng.choice(cells)
    grid[first[0]][first[1]] = "PATH"
    frontier = [(first, step) for step in MOVES.values()]
    while frontier:
        # a stack grows corridors, a random pick grows like Prim's tree
        i = len(frontier) - 1 if method == "dfs" else rng.randrange(len(frontier))
        (r, c), (dr, dc) = frontier.pop(i)
        nr, nc = r + 2 * dr, c + 2 * dc
        if 0 < nr < size and 0 < nc < size and grid[nr][nc] == "WALL":
            grid[r + dr][c + dc] = grid[nr][nc] = "PATH"
            steps = list(MOVES.values())
            rng.shuffle(steps)
            frontier += [((nr, nc), s) for s in steps]
    start, goal = rng.sample(cells, 2)
    grid[start[0]][start[1]], grid[goal[0]][goal[1]] = "START", "GOAL"
    return grid


def render(grid: Grid) -> str:
    return "GRID_START " + " ".join(" ".join(row) + " NEWLINE" for row in grid) + " GRID_END"


def parse(sequence: str | None) -> Grid | None:
    """The square grid between GRID_START and GRID_END with one START and one GOAL; None if malformed."""
    tokens = (sequence or "").split()
    if "GRID_START" not in tokens:
        return None
    inner = tokens[tokens.index("GRID_START") + 1 :]
    if "GRID_END" not in inner:
        return None
    rows: Grid = [[]]
    for token in inner[: inner.index("GRID_END")]:
        if token == "NEWLINE":
            if not rows[-1]:
                return None
            rows.append([])
        elif token in CELLS:
            rows[-1].append(token)
        else:
            return None
    rows = rows if rows[-1] else rows[:-1]
    flat = [c for row in rows for c in row]
    square = rows and all(len(row) == len(rows) for row in rows)
    return rows if square and flat.count("START") == 1 == flat.count("GOAL") else None


def _find(grid: Grid, what: str) -> tuple[int, int]:
    return next((r, row.index(what)) for r, row in enumerate(grid) if what in row)


def shortest_path(grid: Grid) -> list[str] | None:
    """A shortest list of moves from START to GOAL, found breadth first."""
    start, goal = _find(grid, "START"), _find(grid, "GOAL")
    came: dict[tuple[int, int], tuple[tuple[int, int], str] | None] = {start: None}
    queue = deque([start])
    while queue and goal not in came:
        r, c = queue.popleft()
        for name, (dr, dc) in MOVES.items():
            cell = (r + dr, c + dc)
            if 0 <= cell[0] < len(grid) and 0 <= cell[1] < len(grid) and cell not in came and grid[cell[0]][cell[1]] != "WALL":
                came[cell] = ((r, c), name)
                queue.append(cell)
    if goal not in came:
        return None
    path, at = [], goal
    while came[at]:
        at, name = came[at]
        path.append(name)
    return path[::-1]


def validate(sequence: str | None, response: str | None) -> tuple[bool, bool, str, int, int | None]:
    """(success, optimal, reason, actions, optimal length) of a response to a maze."""
    grid = parse(sequence)
    if grid is None:
        return False, False, "invalid_grid", 0, None
    tokens = (response or "").split()
    done = "DONE" in tokens
    actions = tokens[: tokens.index("DONE")] if done else []
    best = shortest_path(grid)
    n = len(actions)
    if best is None:
        return False, False, "unsolvable_grid", n, None
    reason = None
    if response is None:
        reason = "invalid_response"
    elif not done:
        reason = "missing_done"
    elif any(a not in MOVES for a in actions):
        reason = "invalid_action"
    elif any(t not in TRAILING for t in tokens[tokens.index("DONE") + 1 :]):
        reason = "trailing_token"
    else:
        (r, c), goal = _find(grid, "START"), _find(grid, "GOAL")
        for a in actions:
            if (r, c) == goal:
                reason = "action_after_goal"
                break
            r, c = r + MOVES[a][0], c + MOVES[a][1]
            if not (0 <= r < len(grid) and 0 <= c < len(grid)):
                reason = "out_of_bounds"
                break
            if grid[r][c] == "WALL":
                reason = "hit_wall"
                break
        else:
            reason = "success" if (r, c) == goal else "not_at_goal"
    return reason == "success", reason == "success" and n == len(best), reason, n, len(best)

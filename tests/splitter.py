"""A plain recursive splitter, which the one of expressions must equal."""

from quarry.config import ChunkConfig


def split_recursive(text: str, cfg: ChunkConfig) -> list[str]:
    """Chunks of at most cfg.size characters where separators allow, the coarsest first, with overlaps of whole parts."""

    def merge(parts: list[str]) -> list[str]:
        out, held, total = [], [], 0
        for p in parts:
            if held and total + len(p) > cfg.size:
                if joined := "".join(held).strip():
                    out.append(joined)
                while total > cfg.overlap or (total + len(p) > cfg.size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if joined := "".join(held).strip():
            out.append(joined)
        return out

    def cut(piece: str, separators: tuple[str, ...]) -> list[str]:
        at = next(i for i, s in enumerate(separators) if s in piece)
        sep, finer = separators[at], separators[at + 1 :]
        if sep:
            first, *rest = piece.split(sep)
            parts = [p for p in (first, *[sep + r for r in rest]) if p]
        else:
            parts = list(piece)
        out, small = [], []
        for p in parts:
            if len(p) < cfg.size:
                small.append(p)
                continue
            out += merge(small)
            small = []
            out += cut(p, finer) if finer else [p]
        return out + merge(small)

    return cut(text, cfg.separators)

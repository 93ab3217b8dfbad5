"""Plain single-process allocation of one transaction, for comparison."""


def allocate_tx(spendable: list[bool], directives: list, seed: dict[int, int]) -> dict[tuple[int, int], int]:
    """Token amounts per (output, token) of one transaction.

    Targets below n are outputs, n is the multicast, n+1+i is directive i's sheet.
    """
    n = len(spendable)
    outs = [v for v, s in enumerate(spendable) if s]
    routed: list[dict[int, int]] = [{} for _ in directives]
    given: dict[tuple[int, int], int] = {}

    def credit(v: int, token: int, amount: int) -> None:
        if amount > 0:
            given[v, token] = given.get((v, token), 0) + amount

    def send(target: int | None, sheet: dict[int, int]) -> None:
        if target is None:
            return
        for token, amount in sheet.items():
            if target == n:
                for i, v in enumerate(outs):
                    credit(v, token, amount // len(outs) + (1 if i < amount % len(outs) else 0))
            elif target < n:
                if spendable[target]:
                    credit(target, token, amount)
            elif target - n - 1 < len(directives):
                box = routed[target - n - 1]
                box[token] = box.get(token, 0) + amount

    def fold(pairs) -> dict[int, int]:
        out: dict[int, int] = {}
        for p in pairs if pairs is not None else ():
            out[int(p["id"])] = out.get(int(p["id"]), 0) + int(p["value"])
        return out

    for i, d in enumerate(directives):
        sheet = dict(routed[i])
        net_in, net_out, status = fold(d["net_in"]), fold(d["net_out"]), d["status"]
        if status == "revert" and not net_in:
            status = "notrace"
        if status == "revert":
            send(None if d["refund"] is None else int(d["refund"]), net_in)
            continue
        if status == "success":
            for token, amount in net_in.items():
                sheet[token] = max(sheet.get(token, 0) - amount, 0)
            for token, amount in net_out.items():
                sheet[token] = sheet.get(token, 0) + amount
        if i == 0 and status == "notrace":
            for token, amount in seed.items():
                sheet[token] = sheet.get(token, 0) + amount
        for e in d["edicts"] if d["edicts"] is not None else ():
            token, want, target = int(e["token"]), int(e["amount"]), int(e["output"])
            have = sheet.get(token, 0)
            if target == n and want > 0:
                for v in outs:
                    part = min(have, want)
                    credit(v, token, part)
                    have -= part
                sheet[token] = have
            elif target == n and not outs:
                continue
            else:
                take = min(have, want) if want else have
                sheet[token] = have - take
                send(target, {token: take} if take else {})
        rest = {t: a for t, a in sheet.items() if a > 0}
        if d["pointer"] is not None:
            send(int(d["pointer"]), rest)
        elif outs:
            for t, a in rest.items():
                credit(outs[0], t, a)
    return given

"""A stand-in for detector files: JSON, a list of values by branch, with a log of what is read."""

import json


class Branch:
    def __init__(self, key, values, log):
        self.key, self.values, self.log = key, values, log

    def array(self, entry_start, entry_stop):
        with open(self.log, "a") as f:
            f.write(f"{self.key} {entry_start} {entry_stop}\n")
        return Values(self.values[entry_start:entry_stop])


class Values(list):
    def tolist(self):
        return list(self)


class Tree:
    def __init__(self, branches, log):
        self.branches, self.log = branches, log
        self.num_entries = len(next(iter(branches.values())))

    def keys(self):
        return list(self.branches)

    def __getitem__(self, key):
        return Branch(key, self.branches[key], self.log)


def open_json(path):
    with open(path) as f:
        return {name: Tree(branches, f"{path}.log") for name, branches in json.load(f).items()}


def only_momenta(key):
    return key.split(".", 1)[1] in ("Px", "Py", "Pz")

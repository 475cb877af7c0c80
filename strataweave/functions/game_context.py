"""Which part of a game a name belongs to: the first rule that has a word of the lower-cased name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and what they tell, in order, of property names, definition names and class names; and what types tell.
OF_PROPERTY = [
    ("damage attack weapon", "Combat"), ("health stamina food water", "Survival/Stats"), ("craft recipe ingredient", "Crafting"), ("loot harvest drop", "Loot/Harvesting"), ("speed move jump", "Movement"),
    ("sound audio noise", "Audio"), ("light glow emit", "Lighting/Visual"), ("unlock require perk skill", "Progression"), ("price value economic", "Economy"), ("buff effect modifier", "Buffs/Effects"),
    ("spawn probability chance", "Spawning/RNG"), ("block material durability", "Blocks/Building"), ("vehicle fuel", "Vehicles"), ("zombie entity ai", "Entities/AI"),
]
OF_DEFINITION = [
    ("zombie spider wolf", "Enemies"), ("gun pistol rifle shotgun", "Ranged Weapons"), ("axe machete club knife", "Melee Weapons"), ("armor helmet chest boots", "Armor"), ("food water drink can", "Food/Drink"),
    ("medical bandage first antibiotic", "Medical"), ("ammo bullet shell arrow", "Ammunition"),
]
OF_TYPE = {
    "item": "Items/Equipment", "block": "Blocks/Building", "buff": "Buffs/Status Effects", "recipe": "Crafting Recipes", "entity_class": "Entities (Zombies, Animals, NPCs)", "entity_group": "Spawn Groups",
    "loot_group": "Loot Tables", "loot_container": "Loot Containers", "sound": "Audio/Sound Effects", "vehicle": "Vehicles", "quest": "Quests/Missions", "perk": "Perks/Skills", "skill": "Player Skills",
    "game_event": "Game Events/Triggers", "trader": "Traders/Vending",
}
OF_CLASS = [
    ("inventory bag backpack", "Inventory System"), ("craft recipe", "Crafting System"), ("trader vending", "Trading System"), ("vehicle", "Vehicle System"), ("zombie enemy entity", "Entity/AI System"), ("item+action", "Item Actions"),
    ("xui gui hud", "User Interface"), ("buff effect", "Buff/Effect System"), ("spawn director", "Spawning System"), ("loot container", "Loot System"), ("block", "Block System"), ("world chunk", "World System"),
    ("player", "Player System"), ("audio sound", "Audio System"), ("net server client", "Networking"),
]


def _first(name: Column, rules: list[tuple[str, str]], default: Column | str) -> Column:
    low = F.lower(name)
    out = F.lit(default) if isinstance(default, str) else default
    for words, label in reversed(rules):
        found = F.lit(False)
        for word in words.split():
            every = F.lit(True)
            for part in word.split("+"):
                every = every & F.contains(low, F.lit(part))
            found = found | every
        out = F.when(found, label).otherwise(out)
    return out


def of_property(name: Column) -> Column:
    return _first(name, OF_PROPERTY, "Game Property")


def of_type(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in OF_TYPE.items() for x in kv)), kind), F.lit("Game Configuration"))


def of_definition(kind: Column, name: Column) -> Column:
    return _first(name, OF_DEFINITION, of_type(kind))


def of_class(name: Column) -> Column:
    return _first(name, OF_CLASS, "Game Core")


def sql(name: str, rules: list[tuple[str, str]], default: str) -> str:
    """The same rules as SQL, to be held against the columns."""
    word = lambda w: " AND ".join(f"contains(lower({name}), '{p}')" for p in w.split("+"))
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'({word(w)})' for w in words.split())} THEN '{label}'" for words, label in rules) + f" ELSE {default} END"

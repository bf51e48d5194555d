"""Part of pagemark."""

"""Personal data in formats that the operator's own rewriter doesn't make, and numbers that are none."""

import random
def luhn_fix(d):
    for c in "0123456789":
        t=d+c
        if sum(sum(divmod(2*int(x),10)) if i%2 else int(x) for i,x in enumerate(reversed(t)))%10==0: return t
def planted(n, seed=11):
    """(text, kind or None, begin, end): personal data in formats that the training rewriter doesn't make, and other numbers."""
    r=random.Random(seed); out=[]
    words="the report was sent on time and we found nothing new about it before noon".split()
    lead=lambda: " ".join(r.choice(words) for _ in range(r.randint(2,8)))
    for i in range(n):
        who="".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4,9))); host="".join(r.choice("qrstuvwxyzabc") for _ in range(r.randint(4,8))); tld=r.choice(["com","org","de","net"])
        a,b,c=r.randrange(200,999),r.randrange(200,999),r.randrange(1000,9999)
        card=luhn_fix("4"+"".join(r.choice("0123456789") for _ in range(14)))
        ip=[r.randrange(1,255) for _ in range(4)]
        forms={"email":[f"{who}{{at}}{host}{{dot}}{tld}",f"{who} [@] {host}.{tld}",f"{who} [AT] {host} [DOT] {tld}"],
          "phone":[f"({a}) {b} {c}",f"{a}/{b}-{c}",f"{a} . {b} . {c}"],
          "card":["  ".join(card[k:k+4] for k in range(0,16,4)),"_".join(card[k:k+4] for k in range(0,16,4)), " /".join(card[k:k+4] for k in range(0,16,4))],
          "ip":[" .".join(map(str,ip)), f"fe80:0:0:0:{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(65536):x}"]}
        for k,fs in forms.items():
            m=r.choice(fs); l=lead()+" "; out.append((l+m+" "+lead(),k,len(l),len(l)+len(m)))
        y=r.randrange(1990,2030)
        for m in (f"{y}-{r.randrange(1,13):02}-{r.randrange(1,29):02}T{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}",f"{r.randrange(10**9,10**13)}",f"version {r.randrange(9)}.{r.randrange(99)}.{r.randrange(999)}",f"{r.randrange(1,29)}/{r.randrange(1,13)}/{y} {r.randrange(24):02}:{r.randrange(60):02}",f"{r.randrange(100,999)},{r.randrange(100,999)},{r.randrange(100,999)}.{r.randrange(99):02}",f"pages {r.randrange(100,400)}-{r.randrange(400,900)} {y}", f"look at {host} dot by dot"):
            out.append((lead()+" "+m+" "+lead(),None,0,0))
    return out
